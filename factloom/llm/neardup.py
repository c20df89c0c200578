"""Near-duplicate documents by a chosen-path set similarity join.

Sets of word shingles (five words; another length is a parameter) are embedded as minwise tokens. In each of several
independent trees a node holds sets; a node of more than ``leaf`` sets branches by the values of the tree's next tokens:
one token at the first two levels, then several, so many that a pair at the threshold is expected in more than one child
and its chance to stay together doesn't vanish however deep the recursion goes. Nodes are split until they are small.
A node that its next tokens leave whole (one of them has the same value in half of the sets or more) holds near copies
mostly and is taken as it is.

In small nodes all pairs are compared by sketches of the tokens, and what may be similar is joined to candidate groups;
those of all trees, and the whole nodes, are merged by their ids alone. Then the texts are fetched, once for each set in
a group. In groups of at most ``leaf`` sets the intersections of all pairs are counted exactly. In a larger group all
sets are compared with its most central one; those that it doesn't link are compared by their sketches with all of the
group, first with the best few and then, if still unlinked with a candidate, block by block on the full sets. No
candidate pair of two components is left uncompared. Links join into components by alternating large-star and small-star
steps. Equal sets are one vertex from the start, so a group of copies costs its distinct texts only.

The number of trees follows from the threshold and RECALL: a pair at the threshold is compared on its full sets with at
least that chance, whatever the depth of its nodes, the sketch counted in. After a tree's own tokens it goes on with
those of the next tree; such nodes are of one tree still, but no longer independent of the next.

Memory: a task holds one node or group of at most ``leaf`` sets, or two blocks of SKETCH_BLOCK sketches. Shuffled rows:
(node, id, sketch) of 32 bytes per tree, and the texts of sets in groups.

Defined cases: A-Z are lower-cased; words are separated by ASCII white space. With fewer words than a shingle the whole
sequence is the only element; without words the set is empty and linked with nothing. Equal ids are one vertex if
their sets are equal; otherwise each row has its own. Ties go to the smallest id, a null id is the last; a component of
null ids only has a null id. An empty table gives no rows. Extra columns of any name play no part.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import TwoAgeCache, join_hot, materialize
from factloom.llm.url_filter import build_filter

#: The least chance that a pair at the threshold is compared on its full sets, however deep its nodes are split. Of what
#: may be missed, the trees take all but SKETCH_PART.
RECALL, SKETCH_PART = 0.999, 0.05
#: Symbols of a sketch: the two low bits of so many tokens.
SKETCH = 64
#: Levels of a tree by one token each, and those after them by several.
SINGLE, SEVERAL = 2, 3
#: Sets in a node or group that is compared as a whole at most.
LEAF = 512
#: Sketches in a block (24 bytes each), and a set's best candidates that are tried before blocks of full sets.
SKETCH_BLOCK, BEST = 4096, 4
#: Links at most whose components are found in one task (16 bytes each); with more, steps over all of them come before.
TOGETHER = 1_000_000
#: Nodes at most whose keys are broadcast (16 bytes each); with more, only those of most rows are.
MOST_BROADCAST = 200_000
#: Ids at most for which a Bloom filter (10 bits each) goes before the texts' join; it only spares work.
MOST_FILTERED = 10_000_000


@functools.cache
def constants(tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of the tokens' hash functions."""
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 62, tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, tokens, dtype=np.uint64)


def width(percent: int) -> int:
    """Tokens of a level after the single ones: a pair at the threshold is expected in 1.6 children at least."""
    return max(2, math.ceil(160 / percent))


def tree_tokens(percent: int) -> int:
    return SINGLE + SEVERAL * width(percent)


def meeting(similarity: float, percent: int) -> float:
    """The least chance, over all depths, that a pair meets in a node of one tree for the threshold ``percent``.

    That is the survival of a branching process: at a level of k tokens a pair goes on in as many children as tokens agree.
    """
    chance = 1.0
    for _ in range(10_000):
        chance = 1 - (1 - similarity * chance) ** width(percent)
    return chance * similarity**SINGLE


def trees_needed(percent: int) -> int:
    """The trees by which a pair at the threshold misses all nodes seldom enough for RECALL."""
    meet = meeting(percent / 100, percent)
    return 1 if meet >= 1 else math.ceil(math.log((1 - RECALL) * (1 - SKETCH_PART)) / math.log1p(-meet))


def tokens_needed(percent: int) -> int:
    return max(SKETCH, trees_needed(percent) * tree_tokens(percent))


def expected_recall(similarity: float, percent: int) -> float:
    """The least chance that a pair meets in a node of at least one tree."""
    return 1 - (1 - meeting(similarity, percent)) ** trees_needed(percent)


def least_matches(threshold: float) -> int:
    """Matching symbols of two sketches below which a pair counts as refuted: as many as a pair at the threshold reaches
    but for the sketches' part of what may be missed, by the binomial distribution. Other tokens match in one of four."""
    most, below, match = (1 - RECALL) * SKETCH_PART, 0.0, threshold + (1 - threshold) / 4
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * match**k * (1 - match) ** (SKETCH - k)
        if below > most:
            return max(1, k)
    return SKETCH


class Shingler:
    """64-bit shingle sets of texts; hashes of words are cached."""

    def __init__(self, size: int):
        self.size = size
        self.words = TwoAgeCache(xxhash.xxh64_intdigest, 150_000)

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of the text's shingles."""
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.empty(0, dtype=np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, parts), dtype=np.uint64, count=len(parts))
        n = min(self.size, len(parts))
        # a shorter sequence is an element of its own kind
        out = np.full(len(parts) - n + 1, np.uint64(n), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = (out ^ hashes[k : len(parts) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return np.unique(out)


def mark_of(elements: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return xxhash.xxh3_128_digest(elements.tobytes())


def minwise(elements: np.ndarray, tokens: int) -> np.ndarray:
    """``tokens`` minwise tokens (32 bits) of a set that isn't empty."""
    factors, shifts = constants(tokens)
    out = np.full(tokens, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(elements), 4096):
            x = elements[start : start + 4096]
            out = np.minimum(out, ((x[:, None] ^ shifts) * factors).min(0))
        out ^= out >> np.uint64(31)
        return ((out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def planes(tokens: np.ndarray) -> tuple[int, int]:
    """The sketch: the lowest and the second bits of the first SKETCH tokens, as two longs."""
    low = tokens[:SKETCH]
    return tuple(int(np.packbits((low >> k & 1).astype(np.uint8)).view(np.int64)[0]) for k in (np.uint32(0), np.uint32(1)))


def matches(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """The number of equal symbols of each sketch with each other one."""
    differ = (low[:, None] ^ other_low[None, :]) | (high[:, None] ^ other_high[None, :])
    return SKETCH - np.bitwise_count(differ.view(np.uint64)).astype(np.int16)


def embed(own: DataFrame, size: int, tokens_of_set: int) -> DataFrame:
    """For rows (_id, _key, _text): _id, _key, n (elements), mark, low, high (the sketch) and tokens (array<int>) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(size)
        for batch in batches:
            rows = []
            for value in batch["_text"]:
                x = shingles(value)
                if len(x):
                    tokens = minwise(x, tokens_of_set)
                    rows.append((len(x), mark_of(x), *planes(tokens), tokens.view(np.int32)))
                else:
                    rows.append((0, None, 0, 0, None))
            n, marks, low, high, tokens = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"_id": batch["_id"], "_key": batch["_key"], "n": np.array(n, dtype=np.int64), "mark": list(marks),
                                "low": np.array(low, dtype=np.int64), "high": np.array(high, dtype=np.int64), "tokens": list(tokens)})

    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInPandas(run, f"_id {kind}, _key long, n long, mark binary, low long, high long, tokens array<int>")


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _split(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``nodes`` (node, n: rows), and the others. No node's rows meet in one task."""
    nodes = nodes.select("node", "n", F.lit(True).alias("_in"))
    if nodes.count() <= MOST_BROADCAST:
        found = rows.join(F.broadcast(nodes.drop("n")), "node", "left")
    else:
        found = join_hot(rows, nodes, "node", "n")
    return found.filter("_in").drop("_in"), found.filter("_in is null").drop("_in")


def grow(sets: DataFrame, percent: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """The trees over ``sets`` (v, low, high, tokens): rows (node, v, low, high) of small nodes, and those of nodes left whole.

    At each level keys only are counted, with map-side sums; rows of large nodes are written for the next level.
    """
    trees, length, several = trees_needed(percent), tree_tokens(percent), width(percent)
    schema = ["node", "v", "low", "high"]
    rest = lambda tree: F.slice("tokens", tree * length + 1, F.lit(length))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = sets.select("v", "low", "high", "tokens", tree.alias("tree")).select("v", "low", "high", "tree", rest(F.col("tree")).alias("rest"))
    rows = rows.withColumn("node", F.xxhash64("tree", F.get("rest", F.lit(0))))
    heavy = materialize(rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > leaf))
    if heavy.isEmpty():
        return rows.select(schema), rows.select(schema).limit(0)
    large, others = _split(rows, heavy)
    small, whole, rows = [others.select(schema)], [], materialize(large)
    own = [(k,) for k in range(1, SINGLE)]
    own += [tuple(range(k, k + several)) for k in range(SINGLE, length, several)]
    later = [tuple(range(k, min(k + several, length))) for k in range(0, length, several)]
    for turn in range(trees):
        if turn:  # the tree's tokens are used up
            more = sets.select("v", "tokens").join(rows.select("v").distinct(), "v", "left_semi")
            rows = materialize(rows.drop("rest").join(more, "v").withColumn("rest", rest(F.pmod(F.col("tree") + turn, F.lit(trees)))).drop("tokens"))
        for level in own if turn == 0 else later:
            keys = F.array(*[F.xxhash64("node", F.lit(turn * length + k), F.get("rest", F.lit(k))) for k in level])
            counts = rows.select("node", F.explode(keys).alias("child")).groupBy("node", "child").agg(F.count("*").alias("m"))
            counts = materialize(counts.filter(2 * F.col("m") >= leaf))
            together = materialize(counts.join(heavy, "node").groupBy("node", "n").agg(F.max("m").alias("m")).filter("2 * m >= n").select("node", "n"))
            if not together.isEmpty():
                kept, rows = _split(rows, together)
                whole.append(kept.select(schema))
            children = rows.withColumn("node", F.explode(keys))
            heavy = materialize(counts.join(together, "node", "left_anti").filter(F.col("m") > leaf).select(F.col("child").alias("node"), F.col("m").alias("n")))
            if heavy.isEmpty():
                return _union([*small, children.select(schema)]), _union(whole) if whole else children.select(schema).limit(0)
            large, others = _split(children, heavy)
            small.append(others.select(schema))
            rows = materialize(large)
    return _union(small), _union([*whole, rows.select(schema)])


def by_group(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of at least two rows of a stream that is sorted by ``key``; no more than one is kept."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        if rest is not None and len(rest):
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                yield frame.iloc[a:b]
        rest = frame.iloc[starts[-1] :]
    if rest is not None and len(rest) > 1:
        yield rest


def connected(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row that it's connected with."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidates(nodes: DataFrame, least: int) -> DataFrame:
    """(a, b): each set of a small node with the first of those that sketches join it with."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        for group in by_group(frames, "node"):
            low, high = group["low"].to_numpy(), group["high"].to_numpy()
            label = connected(matches(low, high, low, high) >= least)
            joined = np.flatnonzero(label != np.arange(len(label)))
            if len(joined):
                v = group["v"].to_numpy()
                found.append(np.stack([v[joined], v[label[joined]]], axis=1))
            if len(found) > 5000:
                yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])
                found = []
        if found:
            yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    dealt = nodes.repartition("node").sortWithinPartitions("node", "v")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def whole_nodes(nodes: DataFrame) -> DataFrame:
    """(a, b): each set of a node with the node's first."""
    first = materialize(nodes.groupBy("node").agg(F.min("v").alias("b"), F.count("*").alias("n")))
    return join_hot(nodes.select("node", F.col("v").alias("a")), first, "node", "n", "inner").filter("a != b").select("a", "b").distinct()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def intersections(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets ``rows`` (places) with all sets, which are sorted.

    Ranges of elements are taken one after another, so that a few MB are held besides the sets.
    """
    out = np.zeros((len(rows), len(sets)), dtype=np.int64)
    parts = -(-sum(map(len, sets)) // 500_000)
    bounds = [k * (1 << 64) // parts for k in range(1, parts)]
    cuts = [np.r_[0, np.searchsorted(x, np.array(bounds, dtype=np.uint64)), len(x)].astype(np.int64) for x in sets]
    for k in range(parts):
        own = [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)]
        places = np.repeat(np.arange(len(own)), [len(x) for x in own])
        _, column, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = counts[column] > 1
        places, column = places[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        places, column = places[order], column[order]
        for start in range(0, int((counts > 1).sum()), 4096):
            a, b = np.searchsorted(column, [start, start + 4096])
            # sums of at most 4096 ones are exact
            one = np.zeros((len(sets), int(column[b - 1]) - start + 1), dtype=np.float32)
            one[places[a:b], column[a:b] - start] = 1
            out += (one[rows] @ one.T).astype(np.int64)
    # elements of one set only were left out
    out[np.arange(len(rows)), rows] = [len(sets[k]) for k in rows]
    return out


def confirm(members: DataFrame, percent: int, size: int, side: bool = False) -> DataFrame:
    """Links (a, b) between the sets of each cluster, confirmed on the full sets.

    ``members``: cluster, v, mark, _text, and side. Enough links are returned to connect what all links connect. With
    ``side`` only pairs of which one has side 0 are compared: the others meet elsewhere.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(size)
        for group in by_group(frames, "cluster"):
            sets, sides, ids = [], [], []
            seen = set()
            for value, v, mark, one in zip(group["_text"], group["v"], group["mark"], group["side"], strict=True):
                x = shingles(value)
                # keys of rows may clash
                if len(x) and v not in seen and mark_of(x) == mark:
                    seen.add(v)
                    sets.append(x)
                    sides.append(one)
                    ids.append(v)
            if len(sets) < 2:
                continue
            lengths = np.array([len(x) for x in sets])
            own = np.flatnonzero(np.array(sides) == 0) if side else np.arange(len(sets))
            if not len(own):
                continue
            both = intersections(sets, own)
            near = 100 * both >= percent * (lengths[own][:, None] + lengths[None, :] - both)
            parent = list(range(len(sets)))

            def root(k: int, parent=parent) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            out = []
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                i = int(own[i])
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    out.append((ids[i], ids[j]))
                    if len(out) == len(sets) - 1:
                        break
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    dealt = members.select("cluster", "v", "mark", "_text", "side").repartition("cluster").sortWithinPartitions("cluster", "v")
    return dealt.mapInPandas(run, "a long, b long")


def central(members: DataFrame) -> DataFrame:
    """(cluster, center, n): the set of each group whose sketch is nearest to the majority of the group's, bit by bit."""
    bit = lambda c, k: F.sum(F.shiftright(c, k).bitwiseAND(F.lit(1)))
    sums = members.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[bit("low", k) for k in range(64)]).alias("_l"), F.array(*[bit("high", k) for k in range(64)]).alias("_h"))

    def major(sums: str) -> Column:
        bits = F.transform(sums, lambda s, k: F.when(2 * s > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    sums = materialize(sums.select("cluster", "n", major("_l").alias("_l"), major("_h").alias("_h")))
    met = join_hot(members, sums.withColumn("_n", F.col("n")), "cluster", "_n", "inner")
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("_l")).bitwiseOR(F.col("high").bitwiseXOR(F.col("_h"))))
    return met.groupBy("cluster", "n").agg(F.min(F.struct(apart.alias("apart"), "v")).alias("_c")).select("cluster", "n", F.col("_c.v").alias("center"))


def star(members: DataFrame, centers: DataFrame, percent: int, size: int, leaf: int) -> DataFrame:
    """(cluster, v, center, near): whether each set of a large group is linked with its central one.

    A group is dealt out in parts; each gets the center's text, and its rows pass one by one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(size)
        at, middle = None, None
        for frame in frames:
            out = []
            columns = [frame[c] for c in ("cluster", "_part", "v", "center", "mark", "_text")]
            for cluster, part, v, center, mark, text in zip(*columns, strict=True):
                x = shingles(text)
                if mark_of(x) != mark:  # keys of rows may clash
                    continue
                if v == center:
                    at, middle = (cluster, part), x
                    if part == 0:
                        out.append((cluster, v, center, True))
                else:
                    out.append((cluster, v, center, at == (cluster, part) and similar(x, middle, percent)))
            yield pd.DataFrame(out, columns=["cluster", "v", "center", "near"])

    met = join_hot(members.select("cluster", "v", "mark", "_text"), centers.select("cluster", "center", "n", F.ceil(F.col("n") / leaf).cast("int").alias("_parts")), "cluster", "n", "inner")
    middle = F.col("v") == F.col("center")
    parts = F.when(middle, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int")))
    dealt = met.withColumns({"_part": F.explode(parts), "_first": ~middle}).drop("_parts")
    return dealt.repartition("cluster", "_part").sortWithinPartitions("cluster", "_part", "_first").mapInPandas(run, "cluster long, v long, center long, near boolean")


def sketch_pairs(members: DataFrame, sizes: DataFrame, least: int, best: int | None) -> DataFrame:
    """(cluster, a, b): candidates b of each set a that ``far`` marks, by sketches in blocks; its ``best`` ones of each block,
    or those of another ``label``.

    ``members``: cluster, v, low, high, far, label; ``sizes``: cluster, n, f (those far).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(frames, "_block"):
            far = group["_side"].to_numpy() == 0
            low, high, v, label = (group[c].to_numpy() for c in ("low", "high", "v", "label"))
            others, own = np.flatnonzero(~far), np.flatnonzero(far)
            for start in range(0, len(own), 256):
                some = own[start : start + 256]
                score = matches(low[some], high[some], low[others], high[others])
                score[(v[some][:, None] == v[others][None, :]) | (score < least)] = 0
                if best is None:
                    score[label[some][:, None] == label[others][None, :]] = 0
                elif score.shape[1] > best:
                    cut = -np.partition(-score, best - 1, axis=1)[:, best - 1]
                    score[score < cut[:, None]] = 0
                    score[np.cumsum(score > 0, axis=1) > best] = 0
                i, j = np.nonzero(score)
                if len(i):
                    yield pd.DataFrame({"cluster": group["cluster"].iloc[0], "a": v[some[i]], "b": v[others[j]]})

    blocks = lambda c: F.ceil(F.col(c) / SKETCH_BLOCK).cast("int")
    dealt = join_hot(members, sizes.withColumn("_n", F.col("n")), "cluster", "_n", "inner")
    columns = ["cluster", "v", "low", "high", "label"]
    place = lambda c, seed: F.pmod(F.xxhash64("v", F.lit(seed)), blocks(c)).cast("int")
    everyone = dealt.select(*columns, place("n", 1).alias("_b"), F.explode(F.sequence(F.lit(0), blocks("f") - 1)).alias("_g"), F.lit(1).alias("_side"))
    far = dealt.filter("far").select(*columns, F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("_b"), place("f", 2).alias("_g"), F.lit(0).alias("_side"))
    both = everyone.unionByName(far).withColumn("_block", F.xxhash64("cluster", "_b", "_g")).drop("_b", "_g")
    return both.repartition("_block").sortWithinPartitions("_block", "_side", "v").mapInPandas(run, "cluster long, a long, b long")


def large_links(members: DataFrame, texts: DataFrame, percent: int, size: int, leaf: int, least: int) -> DataFrame:
    """Links within groups of over ``leaf`` sets (``members``: cluster, v, low, high; ``texts``: cluster, v, mark, _text)."""
    centers = materialize(central(members))
    judged = materialize(star(texts, centers, percent, size, leaf))
    links = judged.filter("near and v != center").select(F.col("v").alias("a"), F.col("center").alias("b"))
    sizes = materialize(judged.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("f")).filter("f > 0"))
    if sizes.isEmpty():
        return links
    label = F.when(F.col("near"), F.col("center")).otherwise(F.col("v"))
    own = materialize(members.join(judged.select("v", (~F.col("near")).alias("far"), label.alias("label")), "v"))
    text = texts.select("v", "mark", "_text")
    # each far set with its best candidates
    pairs = materialize(sketch_pairs(own, sizes, least, BEST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    two = pairs.select(F.xxhash64("a", "b").alias("cluster"), F.explode(F.array("a", "b")).alias("v")).join(text, "v")
    tried = materialize(confirm(two.withColumn("side", F.lit(0)), percent, size))
    links = links.unionByName(tried)
    # far sets that are linked with one of the central set's now, and those that still have another candidate, block by block
    ways = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = ways.join(own.filter("not far").select(F.col("v").alias("b"), F.col("label").alias("center")), "b").groupBy(F.col("a").alias("v")).agg(F.min("center").alias("center"))
    own = materialize(own.join(joined, "v", "left").withColumn("label", F.coalesce("center", "label")).drop("center"))
    rest = materialize(sketch_pairs(own, sizes, least, None))
    if rest.isEmpty():
        return links
    half = max(1, leaf // 2)
    sides = rest.select("cluster", F.col("a").alias("v"), F.lit(0).alias("side")).distinct().unionByName(rest.select("cluster", F.col("b").alias("v"), F.lit(1).alias("side")).distinct())
    sides = materialize(sides)
    counts = materialize(sides.groupBy("cluster").agg(F.count_if(F.col("side") == 0).alias("f"), F.count_if(F.col("side") == 1).alias("n"), F.count("*").alias("_n")))
    dealt = join_hot(sides, counts, "cluster", "_n", "inner")
    blocks = lambda c: F.ceil(F.col(c) / half).cast("int")
    place = lambda c: F.pmod(F.xxhash64("v", "side"), blocks(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    own_side = F.col("side") == 0
    dealt = dealt.withColumns({"_f": F.explode(F.when(own_side, F.array(place("f"))).otherwise(every("f")))})
    dealt = dealt.withColumns({"_b": F.explode(F.when(own_side, every("n")).otherwise(F.array(place("n"))))})
    both = dealt.select(F.xxhash64("cluster", "_f", "_b").alias("cluster"), "v", "side").groupBy("cluster", "v").agg(F.min("side").alias("side"))
    return links.unionByName(confirm(both.join(text, "v"), percent, size, True))


def components(links: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(v, root) of all vertices of ``links`` (a, b), root being the smallest vertex of a component.

    Large-star and small-star steps run until nothing changes; a hub's links stay apart in their joins. What has at most
    ``together`` links, from the start or after some steps, is finished in one task.
    """
    pairs = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).filter("u != w").distinct())
    signature = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "w")), F.bit_xor(F.xxhash64("w", "u"))).first())
    before = signature(pairs)
    while before[0]:
        if before[0] <= together:
            return materialize(pairs.coalesce(1).mapInPandas(roots_of, "v long, root long"))
        # large star: each vertex's larger neighbours get its smallest neighbour
        both = pairs.unionByName(pairs.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = materialize(both.groupBy("u").agg(F.least(F.first("u"), F.min("w")).alias("_m"), F.count("*").alias("_n")))
        large = join_hot(both.filter("w > u"), least, "u", "_n", "inner").select(F.col("w").alias("u"), F.col("_m").alias("w")).distinct()
        large = materialize(large)
        # small star: each vertex's smaller neighbours get the smallest of them
        low = materialize(large.groupBy("u").agg(F.min("w").alias("_m"), F.count("*").alias("_n")))
        several = join_hot(large, low.filter("_n > 1"), "u", "_n", "inner").select(F.col("w").alias("u"), F.col("_m").alias("w")).filter("u != w")
        pairs = materialize(several.unionByName(low.select("u", F.col("_m").alias("w"))).distinct())
        after = signature(pairs)
        if after == before:
            break
        before = after
    ends = pairs.select(F.col("u").alias("v"), F.col("w").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("v"), "root").distinct())


def roots_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The smallest vertex of each one's component, of all links of a stream."""
    found = [f[["u", "w"]].to_numpy() for f in frames]
    if not found:
        return
    ids, at = np.unique(np.concatenate(found), return_inverse=True)
    at, label = at.reshape(-1, 2), np.arange(len(ids))
    while True:
        new = label.copy()
        least = np.minimum(label[at[:, 0]], label[at[:, 1]])
        for side in (0, 1):
            np.minimum.at(new, at[:, side], least)
            np.minimum.at(new, label[at[:, side]], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"v": ids, "root": ids[label]})


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (own, and others) with the text of each row ``own``.

    A Bloom filter of the rows' keys, if it fits its bound, keeps other documents' texts out of the shuffle; the join is exact.
    """
    n = wanted.count()
    if 0 < n <= MOST_FILTERED:
        own = build_filter(wanted.select(F.col("own._key").cast("string").alias("key")), n, 0.01, 11)
        docs = docs.filter(own.has(F.col("_key").cast("string")))
    rows = wanted.withColumns({"_key": F.col("own._key"), "_own_id": F.col("own._id")}).drop("own")
    return rows.join(docs, "_key").filter(F.col("_own_id").eqNullSafe(F.col("_id"))).drop("_key", "_own_id", "_id")


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, leaf: int = LEAF, row: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id of its component) and kept.

    ``row`` may name a stored column of unique longs. It's added to the result then, and one row of each component is kept.
    """
    # rows are found again by their ids and texts, which repeat for equal rows only; ids may be null
    key = F.xxhash64(docs[id_column], docs[text]) if row is None else docs[row]
    rows = docs.select(docs[id_column].alias("_id"), key.alias("_key"), docs[text].alias("_text"))
    sets = materialize(embed(rows, size, tokens_needed(percent)))
    itself = F.struct(F.col("_id").isNull().alias("nil"), "_id", "_key")
    # equal sets are one vertex; its row is that with the smallest id
    distinct = sets.filter("n > 0").groupBy("mark").agg(
        F.min(itself).alias("own"), F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("low", "high", "tokens")])
    distinct = materialize(distinct.withColumn("v", F.monotonically_increasing_id()))
    small, whole = grow(distinct, percent, leaf)

    least = least_matches(percent / 100)
    groups = components(candidates(small, least).unionByName(whole_nodes(whole)))
    members = materialize(distinct.select("v", "mark", "own", "low", "high").join(groups.withColumnRenamed("root", "cluster"), "v"))
    sizes = materialize(members.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > leaf))
    members = materialize(join_hot(members, sizes.withColumns({"_n": F.col("n"), "large": F.lit(True)}).drop("n"), "cluster", "_n").withColumn("large", F.coalesce("large", F.lit(False))))
    # texts are fetched once, of the sets that are to be compared only
    texts = materialize(fetch(rows, members.select("v", "mark", "own", "cluster", "large")).withColumn("side", F.lit(0)))
    links = confirm(texts.filter("not large"), percent, size)
    if not sizes.isEmpty():
        links = links.unionByName(large_links(members.filter("large").select("cluster", "v", "low", "high"), texts.filter("large"), percent, size, leaf, least))
    roots = components(materialize(links))
    # a component's row is the smallest of its vertices' rows
    linked = materialize(members.select("v", "mark", "own").join(roots, "v"))
    smallest = linked.groupBy("root").agg(F.min("own").alias("_c"), F.count("*").alias("_r"))
    per_set = join_hot(linked.select("mark", "root"), materialize(smallest), "root", "_r", "inner").select("mark", "_c")
    per_set = distinct.select("mark", "own", "_n").join(per_set, "mark", "left").select("mark", "_n", F.coalesce("_c", "own").alias("_component"))
    out = join_hot(sets.select("_id", "_key", "n", "mark"), materialize(per_set), "mark", "_n")
    component = F.when(F.col("_component").isNull(), F.col("_id")).otherwise(F.col("_component._id"))
    columns = [F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")]
    if row is None:
        return out.select(*columns, F.col("_id").eqNullSafe(component).alias("kept"))
    return out.select(*columns, (F.col("_component").isNull() | (F.col("_key") == F.col("_component._key"))).alias("kept"), F.col("_key").alias(row))
