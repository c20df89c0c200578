"""The command line (X2) and a line-oriented JSON-RPC loop (X3, S19, K14) over the same functions."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars, text
from factloom.operators import aggregates, crypto, exports, frontends, method_flow, rules, taint
from factloom.plans import dsl
from factloom.sources import files


def inventory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Facts of a source tree by table."""
    scanned = files.scan(files.read_texts(spark, path), "inventory")
    facts = frontends.extract(scanned)
    of = lambda *kinds: facts.filter(F.col("fact").isin(*kinds))
    ends = frontends.endpoints(scanned.filter(F.col("language").isin("csharp", "vb")))
    return {
        "methods": of("method", "constructor"), "calls": of("call", "constructor_call"), "dependencies": of("dependency"), "properties": of("property"),
        "fields": of("field"), "events": of("event"), "apiEndpoints": ends, "entryPoints": frontends.entry_points(facts, ends),
    }


def dataflows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Slices by lines (R, F#, C/C++) and by methods (C#, Visual Basic), with the graph of their ends."""
    scanned = files.scan(files.read_texts(spark, path))
    by_line = taint.line_slices(taint.mark_lines(text.with_context(text.lines(scanned.filter(~F.col("language").isin("csharp", "vb"))))))
    facts = frontends.extract(scanned.filter(F.col("language").isin("csharp", "vb")))
    by_method = method_flow.slices(scanned, facts, rules.rules(spark))
    slices = by_line.unionByName(by_method, allowMissingColumns=True)
    nodes, edges = method_flow.graph(slices)
    return {"slices": slices, "nodes": nodes, "edges": edges}


def report(spark: SparkSession, path: str) -> str:
    """The counts and the first weaknesses of a source tree as Markdown."""
    tables = dataflows(spark, path)
    at = lambda part: F.concat_ws(":", "path", F.col(f"{part}_line").cast("string"))
    found = tables["slices"].select(
        F.concat_ws(":", "path", F.format_string("%08d", "sink_line"), "sink_category").alias("slice_id"), scalars.weakness_kind(F.col("sink_category")).alias("kind"),
        scalars.weakness_number(scalars.weakness_kind(F.col("sink_category"))).alias("cwe"), F.when(F.col("through").isNull(), "High").otherwise("Medium").alias("confidence"),
        at("source").alias("source_location"), at("sink").alias("sink_location"))
    return exports.markdown({name: rows.count() for name, rows in tables.items()}, found)


def diff(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Slice keys that were added or removed between two result documents."""

    def keys(document: str) -> DataFrame:
        rows = dsl.query_documents(spark, document, "slices")
        for name in ("source_category", "sink_category", "sink_argument"):
            rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
        return aggregates.slice_keys(rows)

    return aggregates.difference(keys(old), keys(new))


def secrets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    rows = text.lines(files.scan(files.read_texts(spark, path)))
    classes = crypto.classify(text.symbol_candidates(rows))
    return {"assets": crypto.assets(classes), "materials": text.materials(rows), "findings": crypto.findings(text.misuses(rows))}


TOOLS: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {"methods": inventory, "dataflows": dataflows, "crypto": secrets}


def answer(spark: SparkSession, line: str) -> str:
    """One request: {"id", "method": a tool or query, "params": {"path", "query"}}."""
    try:
        request = json.loads(line)
    except ValueError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
    own = request.get("id") if isinstance(request, dict) else None
    try:
        params = request.get("params", {})
        tables = TOOLS[request["method"] if request["method"] != "query" else params.get("tool", "dataflows")](spark, params["path"])
        if request["method"] == "query":
            found = dsl.query(tables, params["query"])
            tables = {} if found is None else {"rows": found}
        result = json.loads(exports.json_document(tables).first().json) if tables else {"rows": []}
        return json.dumps({"jsonrpc": "2.0", "id": own, "result": result})
    except Exception as error:
        return json.dumps({"jsonrpc": "2.0", "id": own, "error": {"code": -32000, "message": f"{type(error).__name__}: {error}"[:300]}})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in TOOLS:
        one = commands.add_parser(name)
        one.add_argument("--path", required=True)
        one.add_argument("--out", help="folder for a Parquet table per collection; without it one JSON document is printed")
    one = commands.add_parser("query")
    one.add_argument("--input", required=True)
    one.add_argument("--query", required=True)
    one = commands.add_parser("report")
    one.add_argument("--path", required=True)
    one = commands.add_parser("diff")
    one.add_argument("--old", required=True)
    one.add_argument("--new", required=True)
    commands.add_parser("serve")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    if args.command == "serve":
        for line in sys.stdin:
            print(answer(spark, line), flush=True)
    elif args.command == "report":
        print(report(spark, args.path))
    elif args.command == "diff":
        for row in diff(spark, args.old, args.new).orderBy("change", "key").toLocalIterator():
            print(f"{row.change}\t{row.key}")
    elif args.command == "query":
        for row in dsl.query_documents(spark, args.input, args.query).toJSON().toLocalIterator():
            print(row)
    else:
        tables = TOOLS[args.command](spark, args.path)
        if args.out:
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            print(exports.json_document(tables).first().json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
