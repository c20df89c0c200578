"""Host rules and mixing against brute force on small tables."""

import math
import re
from collections import Counter, defaultdict

import pytest

from factloom.llm import mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", " \t\n", "one", "a b c a b c a b c", "x y z x y z\nq q q q", "a\nb\na\n \n\na \nb", "#tag *** $$ %&| <b>",
    "w " * 60, " ".join(f"w{i}" for i in range(80)), "été ñ 漢字 😀\x0b\x0cb", ("a b c d e f " * 40) + "\n" + "z" * 5000,
]


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    repeat = {j for i, t in enumerate(tri) if count[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def test_measures(spark):
    rows = [(i, t, None, f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(TEXTS * 2)]
    got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, lines, repeat = measures(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat), rows[r.doc_id][1]
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)


def test_bad_host_fails_and_good_host_stays(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "short", "en", "bad", 0) for i in range(95)] + [(100 + i, good, "en", "bad", 0) for i in range(5)]
    rows += [(200 + i, good, "en", f"g{i % 4}", 0) for i in range(100)] + [(900, good, "en", None, 0)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[100 + i] for i in range(5))
    assert all(got[200 + i] for i in range(100)) and got[900]


def expected_targets(sizes):
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in sizes if s not in full)
        now = {s for s in sizes if s not in full and rest * weight[s] / w > 2 * sizes[s]} if w else set()
        if not now:
            return {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in sizes}
        full |= now


@pytest.mark.parametrize("hot", [False, True])
def test_targets_are_met(spark, hot):
    rows, n = [], 0
    for i in range(600):
        source = None if i % 17 == 0 else ("hot" if hot and i % 2 else f"s{i % 5}")
        rows.append((i, " ".join(["w"] * (5 + (i * 7919) % 211 if not (hot and i % 3 == 0) else 40)), None, source, 0))
        n += 1
    rows += [(1000, None, None, "s1", 0), (1001, "", None, "zero", 0), (1002, "a b", None, "Z", 0), (1002, "a b", None, "Z", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    targets = expected_targets(dict(sizes))
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(3, 0.002 * targets[s]), (s, taken[s], targets[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    assert quality_rules.judge(empty).count() == 0


@pytest.mark.parametrize("share", [0.02, 0.6, 1.0, 1.5, 1.97])
def test_dual_against_bisection(spark, share):
    """The tilted rates take each target, far from the start and near the cap too."""
    sizes = {"sa": [(1, 50), (7, 400), (900, 3)], "sb": [(3, 10), (40000, 1)]}
    histogram = spark.createDataFrame([(k, s, n) for k, v in sizes.items() for s, n in v], "_key string, size long, n long")
    total = {k: sum(s * n for s, n in v) for k, v in sizes.items()}
    sources = spark.createDataFrame(
        [(k, share * total[k], total[k], sum(n for _, n in v)) for k, v in sizes.items()], "_key string, target double, source_size long, _words_n long")
    for r in mixing.solve_dual(histogram, sources, 2).collect():
        low, high = -1e6, 1e6
        for _ in range(200):
            lam = (low + high) / 2
            taken = sum(n * s * min(2.0, math.exp(min(1.0, lam * s / r["mean"]))) for s, n in sizes[r["_key"]])
            low, high = (lam, high) if taken < share * total[r["_key"]] else (low, lam)
        own = sum(n * s * min(2.0, math.exp(min(1.0, r["lam"] * s / r["mean"]))) for s, n in sizes[r["_key"]])
        assert abs(own - share * total[r["_key"]]) <= 0.011 and abs(own - taken) <= 0.02
