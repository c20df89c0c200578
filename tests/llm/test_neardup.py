"""The chosen-path join against brute force."""

import math
import random
import re

import numpy as np
import pytest

from factloom.llm import neardup

SCHEMA = "doc_id long, text string, source string, n_shingles int, mark string"


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent=80):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(s), least[root(k)], least[root(k)] == i) for k, (i, s) in enumerate(sets))


def families(seed, groups, most, words=60):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(rng.randrange(1, most)):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(900)}"
            rows.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


EDGES = [None, "", "  \n", "one", "ONE", "one two", "One  Two", "one two three", "é É", "É é", "a b " * 3000, "a b " * 3001, "z" * 20000]


@pytest.mark.parametrize("size, leaf, seed", [(2, 512, 1), (5, 512, 2), (2, 4, 3), (2, 8, 4)])
def test_components(spark, size, leaf, seed):
    """A small leaf makes nodes heavy, so that branching, the star and the blocks all run."""
    rows = families(seed, 12 if leaf > 4 else 5, 14)
    rows += [(1000 + i, t) for i, t in enumerate(EDGES)]
    docs = spark.createDataFrame([(i, t, "s", 1, "m") for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in neardup.find(docs, size=size, leaf=leaf).collect())
    assert got == brute(rows, size)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in neardup.find(docs, size=2).collect())
    assert got == [(1, 7, 1, True), (1, 7, 1, True), (2, 7, 1, False), (3, 0, 3, True)]
    assert neardup.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_is_on_target():
    """Whatever the depth of the nodes, trees and sketches together miss no more than the target allows."""
    for percent in (50, 80, 90, 100):
        s, least = percent / 100, neardup.least_matches(percent / 100)
        match = s + (1 - s) / 4
        refuted = sum(math.comb(neardup.SKETCH, k) * match**k * (1 - match) ** (neardup.SKETCH - k) for k in range(least))
        assert neardup.expected_recall(s, percent) - refuted >= neardup.RECALL >= 0.999
    assert neardup.expected_recall(0.9, 80) > 0.9999


def test_survival_is_that_of_the_branching():
    """The fixed point, against a simulation of deep paths."""
    rng, runs, met = random.Random(5), 4000, 0
    for _ in range(runs):
        alive = int(rng.random() < 0.8 and rng.random() < 0.8)
        for _ in range(25):
            alive = min(50, sum(rng.random() < 0.8 for _ in range(2 * alive)))
        met += alive > 0
    assert abs(met / runs - neardup.meeting(0.8, 80)) < 0.03


def test_sketches_count_equal_symbols():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 1 << 32, (6, neardup.SKETCH), dtype=np.uint32)
    low, high = np.array([neardup.planes(t) for t in tokens]).T
    expected = [[int(((a & 3) == (b & 3)).sum()) for b in tokens] for a in tokens]
    assert neardup.matches(low, high, low, high).tolist() == expected


@pytest.mark.parametrize("size, copies", [(2, 150), (5, 90)])
def test_one_large_group(spark, size, copies):
    """Near copies far above the leaf: whole nodes, the central set, the best candidates and the blocks."""
    rng = random.Random(size)
    base, rows = [f"w{k}" for k in range(120)], []
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 14])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    rows += [" ".join(f"y{k}{j}" for j in range(50)) for k in range(30)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "s", 1, "m") for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in neardup.find(docs, size=size, leaf=6).collect())
    assert got == brute(rows, size)


def test_confirming_has_no_sketch_cut(spark):
    """Pairs of a group are compared on their full sets, whatever their sketches say."""
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*words[:-1], f"x{k}"])) for k in range(5)]
    shingles = neardup.Shingler(2)
    members = [(1, k, bytearray(neardup.mark_of(shingles(t))), t, 0) for k, t in rows]
    frame = spark.createDataFrame(members, "cluster long, v long, mark binary, _text string, side int")
    assert neardup.confirm(frame, 80, 2, False).count() == len(rows) - 1
    assert neardup.confirm(frame, 80, 2, True).count() == len(rows) - 1


@pytest.mark.parametrize("together", [0, 100, 10**6])
def test_components_of_a_chain_and_a_hub(spark, together):
    links = [(k, k + 1) for k in range(0, 70)] + [(100, k) for k in range(101, 200)] + [(300, k) for k in range(201, 290)]
    got = {r.v: r.root for r in neardup.components(spark.createDataFrame(links, "a long, b long"), together).collect()}
    assert got == {**{k: 0 for k in range(71)}, **{k: 100 for k in range(100, 200)}, **{k: 201 for k in [*range(201, 290), 300]}}


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 1 << 63, 90_000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(universe, n)) for n in (1, 5, 700, 60_000, 400_000, 300_000)]
    got = neardup.intersections(sets, np.array([2, 4, 5]))
    assert got.tolist() == [[len(np.intersect1d(sets[i], x)) for x in sets] for i in (2, 4, 5)]


def test_null_ids_are_linked(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:-1], "x"])), (3, " ".join([*words[:-2], "y", "z"]))]
    got = neardup.find(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, 3, False), (3, 3, True)}
