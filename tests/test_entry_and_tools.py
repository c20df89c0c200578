"""The driver's contract, the tools and the stream."""

import json
import sys

import pytest

import __spark_entry__ as entry
from factloom import cli
from factloom.streaming import watch


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_need_no_other_subpackage(monkeypatch):
    """Without the training-data operators, or a package that they need, the others stay."""
    from factloom import queries as core

    monkeypatch.setitem(sys.modules, "factloom.llm", None)
    monkeypatch.delitem(sys.modules, "factloom.llm.queries", raising=False)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    assert set(entry.queries()) == set(core.QUERIES) and set(entry.oracle_sql()) == set(core.SQL)


NAMES = ["dsl_numeric_and_contains", "dsl_array_any", "rule_match_modes", "asof_backward", "band_join", "longest_prefix", "unique_candidate_match", "surrogate_ids", "slice_diff", "export_mermaid", "export_graphml", "graph_edges", "dangling_edges", "cbom_dependencies"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    relation = con.sql(entry.oracle_sql()[name])
    order = [relation.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in relation.fetchall())


SOURCE = 'using System;\npublic class P {\n  static void Main(string[] args) {\n    var key = "0123456789abcdef0123456789abcdef";\n    Run(args);\n  }\n}\n'


def test_tools(spark, tmp_path):
    (tmp_path / "P.cs").write_text(SOURCE)
    (tmp_path / "a.R").write_text("cmd <- commandArgs()\nsystem(cmd)\n")
    path = str(tmp_path)
    found = cli.inventory(spark, path)
    assert sorted(r["name"] for r in found["methods"].collect()) == ["Main", "script"] and found["entryPoints"].count() == 1
    reply = json.loads(cli.answer(spark, json.dumps({"id": 1, "method": "query", "params": {"path": path, "query": "slices[sink_category=command]"}})))
    assert len(reply["result"]["rows"]) == 1
    secret = json.loads(cli.answer(spark, json.dumps({"id": 2, "method": "crypto", "params": {"path": path}})))["result"]
    assert secret["materials"][0]["redacted"] == "0123***cdef" and "0123456789abcdef" not in json.dumps(secret)
    assert json.loads(cli.answer(spark, "{"))["error"]["code"] == -32700
    assert json.loads(cli.answer(spark, '{"id": 3, "method": "nope"}'))["error"]["code"] == -32000


def test_stream(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    (source / "P.cs").write_text(SOURCE)
    watch.watch(spark, str(source), str(out), str(state)).awaitTermination(120)
    first = spark.read.parquet(str(out)).count()
    (source / "Q.cs").write_text(SOURCE)
    watch.watch(spark, str(source), str(out), str(state)).awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 2 * first > 0
