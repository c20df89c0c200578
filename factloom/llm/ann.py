"""Approximate nearest neighbours by cosine: a forest of random-projection trees and an exact reranking.

Each level of a tree has one random direction; each inner node splits at the median of its rows' projections. The first
levels are fitted on a bounded sample (``sample`` rows), the further ones, until leaves hold about ``leaf`` rows, on the
projections of all rows (a cut per node goes to the driver, at most 2^MOST_DEPTH a tree). Every row is indexed: it has one
leaf in each tree. A query walks all trees through one shared priority queue, the side of the least margin first, until
the leaves it has taken hold ``budget`` rows. The budget is calibrated: for a bounded set of sample queries the true
neighbours come from brute force over all rows, and the budget is the least that finds ``recall`` of them. Candidates
are then scored exactly, leaf by leaf, as blocks of queries against blocks of rows.

Of a leaf's rows only those come out that can still be among a query's best: a query knows a floor, the score of its
k-th best row so far. The first floor is taken from those rows of the sample that are in the query's own leaves; where
the budget is many times the sample, leaves are scored in phases, each up to GAIN times the rows before it, and each phase
raises the floor. So a query makes at most k rows per leaf in the first phase, which has a bounded number of rows, and
about GAIN per neighbour and tree in each further one, whatever the number of its leaves; no row that could win is lost.

Equal vectors are indexed once, with the smallest ids that can appear in a result (top-k + 1, which is exact). Leaves
that are neighbours in a tree are one part of about ``block`` rows, to which a query is sent once with the list of its
leaves there. Parts with more rows or queries are dealt out in blocks; a block returns each query's best only, ties by
the smallest id, which loses no tied id that could win.

Defined cases: vectors that are null, empty, zero, or that hold a null or non-finite component take no part, neither as
query nor as candidate. Shorter vectors count as filled up with zeros. Components may be as large or small as doubles are:
vectors are scaled by a power of two first, which changes no digit. Rows with the query's own id aren't its neighbours;
repeated rows of one id are one candidate, and each repeated query is answered. Ties go to the smaller id. With fewer
candidates than asked for, all are returned. An empty table gives no rows; other columns, of any name, play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import hash_unit, join_hot, materialize

#: Levels of a tree at most: 2^18 cuts and counts of 8 bytes each a tree are sent to executors.
MOST_DEPTH = 18
#: Rows of the sample by which a node is split at least.
PER_NODE = 32
#: Products of unit vectors that differ by less may be tied.
NEAR = 1e-9
#: Components of sample rows at most that tasks hold to find a query's first floor.
HELD = 1 << 20
#: Rows of a phase at most, as a multiple of those that set the floor.
GAIN = 16


def scaled(vectors) -> np.ndarray:
    """Vectors in double precision, each times a power of two that brings its largest component to 0.5 to 1."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def units(vectors) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with each row of ``b`` (both scaled), one sum per pair: independent of blocks."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth: node k's children are 2k + 1 and 2k + 2; leaves are numbered from 0."""

    directions: np.ndarray  # tree, level, component
    cuts: np.ndarray  # tree, inner node

    @property
    def trees(self) -> int:
        return self.directions.shape[0]

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def projections(self, x: np.ndarray) -> np.ndarray:
        """row, tree, level; one sum per value: independent of the batch."""
        out = np.empty((len(x), self.trees, self.depth))
        for t in range(self.trees):
            for level in range(self.depth):
                out[:, t, level] = (x * self.directions[t, level]).sum(1)
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector in each tree."""
        p, out = self.projections(x), np.zeros((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (p[:, t, level] > self.cuts[t, node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def deeper(self, directions: np.ndarray, cuts: np.ndarray) -> "Forest":
        """One level more: a direction per tree and a cut per leaf."""
        return Forest(np.concatenate([self.directions, directions[:, None]], axis=1), np.concatenate([self.cuts, cuts], axis=1))

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) of all trees in the order of the shared queue: the least margin on the way first."""
        first, p = 2**self.depth - 1, self.projections(x[None])[0]
        queue = [(0.0, 0, t, 0) for t in range(self.trees)]
        while queue:
            bound, up, t, node = heapq.heappop(queue)
            level = -up
            while level < self.depth:  # down the near side, the far ones are queued
                m = float(p[t, level] - self.cuts[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                level += 1
                heapq.heappush(queue, (max(bound, abs(m)), -level, t, far))
                node = near
            yield t, node - first

    def visits(self, x: np.ndarray, counts: np.ndarray, budget: float) -> list[tuple[int, int, int]]:
        """(tree, leaf, rows taken before it)"""
        out, taken = [], 0
        for t, leaf in self.walk(x):
            if taken >= budget:
                break
            if counts[t, leaf]:
                out.append((t, leaf, taken))
                taken += int(counts[t, leaf])
        return out


def drawn(rng: np.random.Generator, trees: int, size: int) -> np.ndarray:
    out = rng.normal(size=(trees, size))
    return out / np.maximum(np.sqrt((out**2).sum(-1, keepdims=True)), 1e-12)


def plant(x: np.ndarray, trees: int, depth: int, rng: np.random.Generator) -> Forest:
    """The first levels, from a sample of unit vectors."""
    forest = Forest(np.zeros((trees, 0, x.shape[1])), np.zeros((trees, 0)))
    for level in range(depth):
        directions, cuts, leaves = drawn(rng, trees, x.shape[1]), np.zeros((trees, 2**level)), forest.leaves(x)
        for t in range(trees):
            p = (x * directions[t]).sum(1)
            for k in np.unique(leaves[:, t]):
                cuts[t, k] = np.median(p[leaves[:, t] == k])
        forest = forest.deeper(directions, cuts)
    return forest


def grow(forest: Forest, index: DataFrame, depth: int, rng: np.random.Generator) -> Forest:
    """Further levels, from the projections of all rows of ``index``; a row per node is collected."""
    while forest.depth < depth:
        directions = drawn(rng, forest.trees, forest.directions.shape[2])
        shared = index.sparkSession.sparkContext.broadcast(forest)

        def project(frames: Iterator[pd.DataFrame], shared=shared, directions=directions) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = units(frame["vector"])
                    leaves = shared.value.leaves(x)
                    for t in range(leaves.shape[1]):
                        yield pd.DataFrame({"tree": np.int32(t), "leaf": leaves[:, t], "p": (x * directions[t]).sum(1)})

        found = index.select("vector").mapInPandas(project, "tree int, leaf long, p double")
        cuts = np.zeros((forest.trees, 2**forest.depth))
        for r in found.groupBy("tree", "leaf").agg(F.percentile_approx("p", 0.5, 200).alias("cut")).toLocalIterator():
            cuts[r.tree, r.leaf] = r.cut
        shared.destroy()
        forest = forest.deeper(directions, cuts)
    return forest


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """vec_id, vector (of doubles or floats, all of one length) and key (its hash) of the rows that take part."""
    fine = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    fine = fine & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.filter(fine).select(F.col(id_column).alias("vec_id"), F.col(vector).alias("vector"))
    least, most = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != most:
        zero = F.lit(0).cast(rows.schema["vector"].dataType.elementType)
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(zero, F.lit(most) - F.size("vector"))))
    return rows.withColumn("key", F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64("vector", F.lit(1)))))


def true_neighbours(index: DataFrame, queries: np.ndarray, top: int) -> list[list[tuple[float, int]]]:
    """The nearest ``top`` rows (v) of a bounded number of queries, by brute force over all rows; self included."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[float, int]]] = [[] for _ in queries]
        for frame in frames:
            if not len(frame):
                continue
            x, keys = units(frame["vector"]), frame["v"].tolist()
            s = queries @ x.T
            k = min(top, len(keys))
            part = np.argpartition(-s, k - 1, axis=1)[:, :k]
            for i, row in enumerate(part):
                best[i] = heapq.nlargest(top, best[i] + [(float(s[i, j]), keys[j]) for j in row])
        rows = [(i, s, k) for i, found in enumerate(best) for s, k in found]
        yield pd.DataFrame(rows, columns=["i", "score", "v"])

    found = index.select("v", "vector").mapInPandas(run, "i int, score double, v long")
    w = Window.partitionBy("i").orderBy(F.desc("score"), "v")
    out: list[list[tuple[float, int]]] = [[] for _ in queries]
    for r in found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top).collect():  # queries * top rows
        out[r.i].append((r.score, r.v))
    return out


def calibrate(index: DataFrame, forest: Forest, counts: np.ndarray, sample: pd.DataFrame, top: int, recall: float, queries: int = 128) -> float:
    """The least budget that finds ``recall`` of the true neighbours of ``queries`` sample rows."""
    x = units(sample["vector"].iloc[:queries])
    truth = true_neighbours(index, x, top + 1)
    wanted = sorted({k for found in truth for _, k in found})  # queries * (top + 1) at most
    vectors = index.join(F.broadcast(index.sparkSession.createDataFrame([(k,) for k in wanted], "v long")), "v").select("v", "vector").collect()
    leaf_of = dict(zip([r.v for r in vectors], forest.leaves(units([r.vector for r in vectors])), strict=True))
    needed = []
    for i, found in enumerate(truth):
        own = int(sample["v"].iloc[i])
        missing, taken, least = {k: leaf_of[k] for _, k in found if k != own}, 0, {}
        for t, leaf in forest.walk(x[i]):
            for k in [k for k, leaves in missing.items() if leaves[t] == leaf]:
                least[k] = taken
                del missing[k]
            if not missing:
                break
            taken += counts[t, leaf]
        needed += least.values()
    # a leaf is taken if fewer rows than the budget came before it
    return float(np.quantile(needed, recall, method="higher")) + 1 if needed else math.inf


def phase_of(taken: float, held: int) -> int:
    """The phase of a leaf before which ``taken`` rows come, if ``held`` rows set the first floor."""
    phase, most = 0, held * GAIN
    while taken >= most:
        phase, most = phase + 1, most * GAIN
    return phase


def leaf_bests(placed: DataFrame, visits: DataFrame, counts: np.ndarray, keep: int, block: int) -> DataFrame:
    """query, v, least and score: of each leaf's rows the ``keep`` best of each query that visits it, above its floor.

    ``counts`` has the rows of each part of a tree. Parts with many rows or queries are dealt out: each of a part's row
    blocks meets each of its query blocks.
    """
    kind = placed.schema["least"].dataType.simpleString()
    sizes = visits.groupBy("tree", "part").agg(F.count("*").alias("q")).toLocalIterator()  # a row per part
    shape = placed.sparkSession.createDataFrame(
        [(r.tree, r.part, max(1, math.ceil(int(counts[r.tree, r.part]) / block)), max(1, math.ceil(r.q / block))) for r in sizes],
        "tree int, part int, nv int, nq int")
    spread = lambda df, own, other, a, b: (
        df.join(F.broadcast(shape), ["tree", "part"]).withColumn(a, F.pmod(F.xxhash64("v"), F.col(own)).cast("int"))
        .withColumn(b, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("nv", "nq"))
    groups = ["tree", "part", "bv", "bq"]
    left, right = spread(placed, "nv", "nq", "bv", "bq"), spread(visits, "nq", "nv", "bq", "bv")

    def rank(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asked):
            found = found.sort_values("leaf", kind="stable")
            raw_x, raw_y = scaled(found["vector"]), scaled(asked["vector"])
            x, y = units(found["vector"]), units(asked["vector"])
            keys, least, names, floor = found["v"].tolist(), found["least"].tolist(), asked["v"].tolist(), asked["floor"].to_numpy()
            visited = np.concatenate([np.asarray(k) for k in asked["leaves"]])
            visitor = np.repeat(np.arange(len(asked)), [len(k) for k in asked["leaves"]])
            leaves, starts = np.unique(found["leaf"].to_numpy(), return_index=True)
            for leaf, lo, hi in zip(leaves.tolist(), starts.tolist(), [*starts[1:].tolist(), len(found)], strict=True):
                those, k = visitor[visited == leaf], min(keep, hi - lo)
                for a in range(0, len(those), 256):
                    own = those[a : a + 256]
                    s = y[own] @ x[lo:hi].T
                    cut = np.maximum(-np.partition(-s, k - 1, axis=1)[:, k - 1] - NEAR, floor[own])
                    row = s >= cut[:, None]
                    for r in np.flatnonzero(row.any(1)).tolist():
                        i, near = int(own[r]), np.flatnonzero(row[r]) + lo
                        exact = cosine(raw_x[near], raw_y[i]).tolist()
                        best = heapq.nsmallest(keep, ((-c, least[j], keys[j]) for c, j in zip(exact, near.tolist(), strict=True)))
                        out += [(names[i], v, first, -c) for c, first, v in best]
        return pd.DataFrame(out, columns=["query", "v", "least", "score"]).astype({"query": "int64", "v": "int64", "score": float})

    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(rank, f"query long, v long, least {kind}, score double")


def search(vectors: DataFrame, is_query: Column, top: int = 5, id_column: str = "vec_id", vector: str = "embedding", trees: int = 3,
           sample: int = 16384, leaf: int = 256, recall: float = 0.97, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``top`` nearest rows found for each query."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_column, vector))
    kind = rows.schema["vec_id"].dataType.simpleString()
    # the smallest ids of each distinct vector; the rank limit is applied before the shuffle
    w = Window.partitionBy("key").orderBy("vec_id")
    few = rows.dropDuplicates(["key", "vec_id"]).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top + 1)
    few = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    index = materialize(few.withColumns({"v": F.monotonically_increasing_id(), "least": F.get("ids", F.lit(0))}))
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "key")
    per_key = materialize(asked.groupBy("key").agg(F.count("*").alias("_n")).join(index.select("key", "v"), "key"))
    chosen = index.orderBy(hash_unit("key", seed=1), "key").limit(sample).select("v", "vector").toPandas()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not len(chosen):
        return spark.createDataFrame([], schema)
    n, rng = index.count(), np.random.default_rng(4)
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(n / leaf))))
    forest = plant(units(chosen["vector"]), trees, min(depth, max(0, int(math.log2(max(1, len(chosen) / min(leaf, PER_NODE)))))), rng)
    forest = grow(forest, index, depth, rng)
    shared = spark.sparkContext.broadcast(forest)
    bits = min(depth, max(0, int(math.log2(max(1.0, block * 2**depth / n)))))  # a part is 2^bits leaves

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                found = shared.value.leaves(units(frame["vector"]))
                for t in range(found.shape[1]):
                    yield frame.assign(tree=np.int32(t), leaf=found[:, t].astype(np.int32), part=(found[:, t] >> bits).astype(np.int32))

    kind_of = index.schema["vector"].dataType.simpleString()
    placed = index.select("v", "least", "vector").mapInPandas(place, f"v long, least {kind}, vector {kind_of}, tree int, leaf int, part int")

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((shared.value.trees, 2**shared.value.depth), dtype=np.int64)
        for frame in frames:
            if len(frame):
                for t, own in enumerate(shared.value.leaves(units(frame["vector"])).T):
                    out[t] += np.bincount(own, minlength=out.shape[1])
        t, k = np.nonzero(out)
        yield pd.DataFrame({"tree": t.astype(np.int32), "leaf": k.astype(np.int32), "n": out[t, k]})

    counts = np.zeros((trees, 2**forest.depth), dtype=np.int64)
    sums = index.select("vector").mapInPandas(tally, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # a row per leaf
        counts[r.tree, r.leaf] = r.n
    budget = calibrate(index, forest, counts, chosen, top, recall)

    keep = top + 1
    known = units(chosen["vector"].iloc[: max(1024, HELD // forest.directions.shape[2])])
    held = spark.sparkContext.broadcast((known, forest.leaves(known)))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, leaves = held.value
        for frame in frames:
            for v, vector, x in zip(frame["v"], frame["vector"], units(frame["vector"]) if len(frame) else [], strict=True):
                found = shared.value.visits(x, counts, budget)
                mine = np.zeros(counts.shape, dtype=bool)
                mine[[t for t, _, _ in found], [n for _, n, _ in found]] = True
                s = known[mine[np.arange(len(mine)), leaves].any(1)] @ x
                floor = float(np.partition(s, len(s) - keep)[len(s) - keep]) - NEAR if len(s) >= keep else -math.inf
                parts: dict[tuple[int, int, int], list[int]] = {}
                for t, leaf, taken in found:
                    parts.setdefault((t, leaf >> bits, phase_of(taken, len(known))), []).append(leaf)
                at = np.array(list(parts), dtype=np.int32)
                yield pd.DataFrame({"v": v, "vector": [vector] * len(parts), "floor": floor, "tree": at[:, 0], "part": at[:, 1], "phase": at[:, 2], "leaves": list(parts.values())})

    queries = index.join(per_key.select("v"), "v", "left_semi").select("v", "vector")
    visits = materialize(queries.mapInPandas(visit, f"v long, vector {kind_of}, floor double, tree int, part int, phase int, leaves array<int>"))
    sizes = counts.reshape(trees, -1, 2**bits).sum(2)
    # equal ranks are one row that several trees have found
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "least", "v")
    scored = None
    for phase in range(1 + phase_of(min(budget, int(counts.sum())) - 1, len(known))):
        now = visits.filter(F.col("phase") == phase).drop("phase")
        if scored is not None:
            reached = scored.groupBy(F.col("query").alias("v")).agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == keep)
            now = now.join(reached, "v", "left").withColumn("floor", F.greatest("floor", F.col("s") - NEAR)).drop("n", "s")
        found = leaf_bests(placed, now, sizes, keep, block)
        found = found if scored is None else scored.unionByName(found)
        scored = materialize(found.withColumn("_n", F.dense_rank().over(nearest)).filter(F.col("_n") <= keep).drop("_n").distinct())
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = scored.join(index.select("v", "ids"), "v").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = (
        ids.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top + 1)
        .groupBy(F.col("query").alias("v")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))).alias("near"))
    )
    answered = join_hot(asked, materialize(lists.join(per_key, "v").drop("v")), "key", "_n")
    others = F.slice(F.filter("near", lambda x: x["v"] != F.col("query_id")), 1, top)
    return answered.select("query_id", F.posexplode(others).alias("_p", "_x")).select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.v").alias("vec_id"), (-F.col("_x.s")).alias("score"))
