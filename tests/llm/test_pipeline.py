"""The pipeline's stages, each against brute force on its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from factloom.llm import pairwise_quality, queries, toxicity
from factloom.llm.common import materialize
from tests.llm.test_neardup import brute
from tests.llm.test_rules_and_mixing import expected_targets


def test_stages(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf))
        seen[name] = (docs, out)
        if name != "bpe":
            assert out.columns == docs.columns
        docs = out

    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.score(before, toxicity.train(before, labels)).collect() if r.predicted}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = seen["quality classifier"]
    good = {r.doc_id for r in pairwise_quality.score(before, pairwise_quality.train(before, labels)).collect() if r.predicted}
    assert {r.doc_id for r in after.collect()} == good
    before, after = seen["near-duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _, _, kept in brute([(r.doc_id, r.text) for r in before.collect()], 5) if kept]

    before, after = seen["mixing"]
    size, source = {}, {}
    for r in before.collect():
        size[r.doc_id], source[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 2
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
        taken[source[i]] += copies[i] * n
    for s, target in expected_targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= max(60, 0.1 * target)

    before, after = seen["bpe"]
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    expected = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in before.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in after.collect()) == expected


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    """A folder with labels of documents 0 to 39: the odd ones are toxic, those from 20 on are good."""
    path = f"file://{tmp_path_factory.mktemp('labels')}"
    spark.createDataFrame([(i, int(i >= 20), i % 2) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, mark string, _copy int, _id int, _text int, label int, _row int"


def clashing(spark, n=40):
    rows = [(i, f"word{i} " * 3 + ("vile scum " if i % 2 else "kind friend ") + ("clear sentence here " * 4 if i >= 20 else "### BUY !!! "), "en", f"s{i % 2}", 9, 0.5, i, "x", 99, 98, 97, 96, 95) for i in range(n)]
    return spark.createDataFrame(rows, CLASHING)


def test_columns_with_clashing_names(spark, labels_dir):
    """Stages keep extra columns and their values, whatever their names."""
    docs = clashing(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, labels_dir)
        assert out.columns == docs.columns
        assert {tuple(r[5:6]) + tuple(r[7:]) for r in out.collect()} == {(0.5, "x", 99, 98, 97, 96, 95)}
    assert sorted(r.doc_id for r in corpus_pipeline.clean(spark, docs, labels_dir).collect()) == list(range(0, 40, 2))
    assert sorted(r.doc_id for r in corpus_pipeline.good(spark, docs, labels_dir).collect()) == list(range(20, 40))
    assert corpus_pipeline.encoded(spark, docs, labels_dir).count() == 40


def test_empty_tables(spark, labels_dir):
    empty = clashing(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, labels_dir).count() == 0


def test_classifier_stages_decide_by_row(spark, labels_dir):
    """Null and repeated ids, null, empty and very long texts."""
    docs = clashing(spark).select("doc_id", "text", "source")
    odd = [(None, "vile scum vile scum", "s"), (None, "kind friend here", "s"), (0, "vile scum " * 30_000, "s"), (0, "kind friend " * 30_000, "s"), (0, "kind friend " * 30_000, "s"), (7, None, None), (8, "", "s")]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    kept = Counter(tuple(r) for r in corpus_pipeline.clean(spark, both, labels_dir).collect())
    assert kept[odd[0]] == 0 and kept[odd[1]] == 1 and kept[odd[2]] == 0 and kept[odd[3]] == 2
    assert kept[odd[5]] == kept[odd[6]]
    good = Counter(tuple(r) for r in corpus_pipeline.good(spark, both, labels_dir).collect())
    assert good[odd[3]] in (0, 2) and good[odd[5]] == good[odd[6]]


ODD = "doc_id long, text string, source string"


def odd_rows():
    """Null ids, repeated rows and an id with two texts, of which one is a near copy of a smaller id."""
    base = [[f"t{k}w{i}" for i in range(60)] for k in range(6)]
    near = base[0][:-1] + ["other"]
    return [(1, " ".join(base[0]), "s"), (5, " ".join(near), "s"), (5, " ".join(base[1]), "s"),
            (7, " ".join(base[2]), "s"), (7, " ".join(base[2]), "s"), (None, " ".join(base[3]), "s"), (None, " ".join(base[4]), "s"),
            (None, " ".join(base[4][:-1] + ["other"]), "s"), (None, " ".join(near), "s"), (None, None, "s"), (None, " ".join(base[5]), "s"), (9, " ".join(base[5]), "s")]


def test_one_row_of_each_component_stays(spark):
    rows = odd_rows()
    got = Counter(tuple(r) for r in corpus_pipeline.distinct(spark, spark.createDataFrame(rows, ODD), "").collect())
    pair = [got.pop(rows[k], 0) for k in (6, 7)]
    assert sorted(pair) == [0, 1]
    assert got == Counter(rows[k] for k in (0, 2, 3, 5, 9, 11))


def test_mixing_keeps_null_and_repeated_ids_apart(spark):
    rows = [(i, "a b c d", "s") for i in (None, None, None, 4, 4, 5)]
    got = corpus_pipeline.mixed(spark, spark.createDataFrame(rows, ODD), "").collect()
    # one source: its target is one and a half times its size, nine rows of four words
    assert len(got) == 9 and max(Counter(r.doc_id for r in got)[i] for i in (4, 5)) <= 4
    assert 3 <= sum(r.doc_id is None for r in got) <= 6
