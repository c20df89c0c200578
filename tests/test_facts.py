"""Joins, aggregates, graphs, taint, frontends and exports on small fixtures."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from factloom import queries
from factloom.functions import scalars, text
from factloom.operators import aggregates, crypto, exports, frontends, graph, joins, line_frontends, rules, taint
from factloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, scalars.redacted(F.lit("12345678"))) == "***"
    assert one(spark, scalars.redacted(F.lit("123456789"))) == "1234***6789"
    assert one(spark, scalars.combined_route(F.lit("api/"), F.lit("/x"))) == "api/x"
    assert one(spark, scalars.package_url(F.lit("A b~*"), F.lit("1.0"))) == "pkg:nuget/A%20b~%2A@1.0"
    assert one(spark, scalars.identifier_parts(F.lit("myAESKey2"))) == ["my", "a", "es", "key", "2"] or one(spark, scalars.identifier_parts(F.lit("apiKey2"))) == ["api", "key", "2"]
    assert one(spark, scalars.is_iv_name(F.lit("initIv"))) and not one(spark, scalars.is_iv_name(F.lit("drive")))
    assert one(spark, scalars.protocol_version(F.lit("TLSv1_2_method"))) == "TLS 1.2"
    assert one(spark, scalars.name_space(F.lit("A.B.C"))) == "A.B" and one(spark, scalars.name_space(F.lit("C"))) is None
    assert one(spark, scalars.without_arity(F.lit("List`1"))) == "List"
    assert one(spark, scalars.relative_path(F.lit("/a/b/c.cs"), F.lit("/a"))) == "b/c.cs"
    assert one(spark, scalars.finding_number(F.lit("CRYPTO-TLS-CERT-VALIDATION-DISABLED"))) == "CWE-295"
    assert one(spark, scalars.trimmed_code(F.lit(" a\r\nb "))) == "a  b"


def test_slices_and_weaknesses(spark):
    nodes = spark.createDataFrame([
        ("source", True, False, "cli", "args", None, "Program.cs", "Program.cs", "Main", 5, 21),
        ("processSink", False, True, "command", "Start", "pkg:process", "Program.cs", "Program.cs", "Main", 10, 9),
        ("otherPackage", False, False, None, "Call", "pkg:other", "Other.cs", "Other.cs", "Run", 20, 13),
    ], "id string, is_source boolean, is_sink boolean, category string, name string, purl string, path string, file_name string, method string, line int, column int")
    edges = spark.createDataFrame([("edge-to-process", "source", "processSink", "pkg:process", "src/Program.cs", "src/Program.cs", 10, 9)],
                                  "id string, source_id string, target_id string, target_purl string, path string, file_name string, line int, column int")
    paths = spark.createDataFrame([("slice1", ["source", "processSink", "otherPackage"], "processSink", "pkg:process", "cli", "command")],
                                  "slice_id string, node_ids array<string>, sink_id string, sink_purl string, source_category string, sink_category string")
    built = graph.slices(paths, edges, nodes).cache()
    row = built.first()
    assert row.source_id == "source" and row.edge_ids == ["edge-to-process"] and row.purls == ["pkg:other", "pkg:process"]
    found = {(r.purl, r.path, r.line) for r in graph.slice_locations(built, nodes, edges).collect()}
    assert found == {("pkg:process", "Program.cs", 10), ("pkg:process", "src/Program.cs", 10), ("pkg:other", "Other.cs", 20)}
    entries = spark.createDataFrame([("ep1", "program.cs", "Other", 3, "/run", 1)], "id string, file_name string, method string, line int, route string, ord int")
    w = graph.weaknesses(built, nodes, entries).first()
    assert (w.kind, w.cwe, w.confidence, w.entry_id, w.route) == ("CommandInjectionCandidate", "CWE-78", "High", "ep1", "/run")
    assert graph.weaknesses(built, nodes).first().confidence == "Medium"
    assert [r.frame for r in exports.traces(built, nodes.filter("id <> 'otherPackage'"), edges.withColumn("label", F.lit("arg"))).orderBy("pos").collect()][-1] == "<missing node>"
    assert "CWE-78" in exports.markdown({"Slices": 1}, graph.weaknesses(built, nodes))


def test_cycles_and_dangling(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source_id string, target_id string")
    got = {r.id: r.depth for r in graph.reach(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("x",)], "id string")
    assert [r.target_id for r in joins.dangling_edges(edges, nodes).collect()] == ["y"]
    assert graph.with_external_nodes(nodes.withColumn("external", F.lit(False)), edges).filter("external").first().id == "y"


def test_as_of_and_intervals(spark):
    left = spark.createDataFrame([(1, "m", 5), (2, "m", 0), (3, "n", 9)], "id int, m string, at int")
    right = spark.createDataFrame([("m", 0, 10), ("m", 5, 20), ("m", 7, 30)], "m string, at int, line int")
    assert {r.id: r.prior_line for r in joins.as_of(left, right, ["m"], "at", ["line"]).collect()} == {1: 20, 2: 10, 3: None}
    assert {r.id: r.prior_line for r in joins.as_of(left, right, ["m"], "at", ["line"], strict=True).collect()} == {1: 10, 2: None, 3: None}


def test_dispatch_is_capped(spark):
    calls = spark.createDataFrame([("c", "I", "Run", 1)], "call_id string, type string, name string, arity int")
    types = spark.createDataFrame([(f"T{i:02d}", "I") for i in range(20)] + [("Z", "I")], "type string, ancestor string")
    methods = spark.createDataFrame([(f"T{i:02d}.Run", f"T{i:02d}", "Run", 1) for i in range(20)] + [("Z.Run", "Z", "Run", 1)], "method_id string, type string, name string, arity int")
    made = types.filter("type <> 'T00'").select("type")
    got = sorted(r.method_id for r in joins.dispatch(calls, types, methods, made).collect())
    assert got == [f"T{i:02d}.Run" for i in range(1, 17)]


def test_crypto_text(spark):
    code = 'private static readonly string ApiKey = "0123456789abcdef0123456789abcdef";\nbyte[] nonce = Get("fixed-nonce1");\nvar h = MD5.Create();\nhandler.X = CipherMode.ECB; SslProtocols.Ssl3\nnew Rfc2898DeriveBytes(p, s, 1000);'
    rows = text.lines(spark.createDataFrame([("a.cs", "csharp", code)], "path string, language string, text string"))
    found = {(r.material_type, r.identifier, r.line, r.redacted) for r in text.materials(rows).collect()}
    assert found == {("key-or-secret", "ApiKey", 1, "0123***cdef"), ("iv-or-nonce", "nonce", 2, "fixe***nce1")}
    assert {(r.rule, r.line) for r in text.misuses(rows).collect()} == {("CRYPTO-ECB-MODE", 4), ("CRYPTO-LEGACY-TLS", 4), ("CRYPTO-LOW-PBKDF2-ITERATIONS", 5)}
    classes = crypto.classify(text.symbol_candidates(rows))
    assert ("MD5", 3) in {(r.algorithm, r.line) for r in classes.collect()}
    assert crypto.findings(text.misuses(rows)).count() == 3


def test_line_taint(spark):
    code = "cmd <- commandArgs()\nx <- 1\nrun <- function(a) {\nsystem(cmd)\nsystem(x)\n}"
    rows = text.with_context(text.lines(spark.createDataFrame([("a.R", "r", code)], "path string, language string, text string")))
    assert rows.filter("line = 4").first().method == "run"
    got = taint.line_slices(taint.mark_lines(rows)).collect()
    assert [(r.name, r.source_line, r.sink_line, r.sink_category) for r in got] == [("cmd", 1, 4, "command")]


SINKS, GUARDS = [("Process.Start(", "command"), ("File.ReadAllText(", "file")], [("Regex.IsMatch", "validation")]


@pytest.mark.parametrize("lines, expected", [
    (["var command = args[0];", "Process.Start(command);"], ["command"]),
    (["var guarded = args[0];", 'if (Regex.IsMatch(guarded, "x")) {', "Process.Start(guarded);", "}"], []),
    (["var path = args[0];", "File.ReadAllText(path);"], ["file"]),
    (["var a = args[0];", 'a = "safe";', "Process.Start(a);"], []),
    (["box.Value = args[0];", "Process.Start(box.Other);", "Process.Start(box.Value);"], ["command"]),
])
def test_method_taint(spark, lines, expected):
    rows = [("m", i + 1, code, {"args": "cli"}) for i, code in enumerate(lines)]
    df = spark.createDataFrame(rows, "method_id string, line int, code string, parameters map<string,string>")
    assert [r.sink_category for r in taint.method_slices(df, [], SINKS, GUARDS).collect()] == expected


def test_summaries_spread(spark):
    rows = [("Run", 1, "Process.Start(command);", {"command": "p"}), ("Main", 1, "Run(args[0]);", {"args": "cli"})]
    df = spark.createDataFrame(rows, "method_id string, line int, code string, parameters map<string,string>")
    calls = spark.createDataFrame([("Main", "args", "Run", "command")], "method_id string, parameter string, callee_id string, callee_parameter string")
    got = {tuple(r) for r in taint.spread_summaries(taint.summaries(df, SINKS), calls).collect()}
    assert ("Main", "args", "sink:command") in got


CS = """using System;
namespace App.Web {
[Route("api/items")]
public class ItemsController {
    private readonly string secret = "x";
    public int Size { get; set; }
    public event EventHandler Changed;
    public ItemsController(int a) { Run(a); }
    [HttpGet("list")]
    [Authorize(Roles = "Admin, User")]
    public string List(string q) {
        return Helper.Find(q);
    }
    static void Main(string[] args) {
        app.MapPost("/orders", Create).RequireAuthorization("p");
    }
}
}"""


def test_frontends(spark):
    rows = [("src/a.cs", CS), ("src/b.fs", "module A.B\nopen System\nlet f x =\n    let inner = 1\n    printfn \"x\"\n"), ("c.R", "library(httr)\nf <- function(x) {\n  g(x)\n}\n"),
            ("d.cpp", "#include <x.h>\nint A::run(int a) {\n  go(a);\n}\n"), ("obj/e.cs", CS), ("f.vb", "Imports System\nPublic Class C\nPublic Sub Go(a As Integer)\nRun(a)\nEnd Sub\nEnd Class\n"), ("g.txt", "x")]
    df = files.scan(spark.createDataFrame(rows, "path string, text string"))
    assert {r.path for r in df.collect()} == {"src/a.cs", "src/b.fs", "c.R", "d.cpp", "f.vb"}
    facts = {(r.path, r.fact, r["name"]) for r in frontends.extract(df).collect()}
    for expected in [("src/a.cs", "constructor", "ItemsController"), ("src/a.cs", "method", "List"), ("src/a.cs", "method", "get_Size"), ("src/a.cs", "property", "Size"), ("src/a.cs", "event", "Changed"),
                     ("src/a.cs", "field", "secret"), ("src/a.cs", "call", "Helper.Find"), ("src/b.fs", "method", "f"), ("src/b.fs", "dependency", "System"), ("c.R", "dependency", "httr"), ("c.R", "call", "g"),
                     ("d.cpp", "method", "run"), ("d.cpp", "call", "go"), ("f.vb", "method", "Go"), ("f.vb", "call", "Run")]:
        assert expected in facts, expected
    assert ("src/b.fs", "method", "inner") not in facts
    ends = {(r.kind, r.verb, r.route, r.requires_auth, r.roles) for r in frontends.endpoints(df.filter("language = 'csharp'")).collect()}
    assert ends == {("controller", "GET", "api/items/list", True, "Admin,User"), ("minimal", "POST", "/orders", True, None)}
    assert frontends.entry_points(frontends.extract(df), frontends.endpoints(df)).count() == 3


FSHARP = """namespace Shop.Core
open type System.Math
let before = 1
type Cart() =
    member this.Total items =
        let inner = sum items
        printfn "x" inner
    member this.Clear (x) = reset x
module Shop.Tools
let rec run x =
  if run (x) then Helper.go x
let ``odd`` = 1
"""
CPP = """#include <x.h>
setup(1);
int fact(int n) { return n < 2 ? 1 : n * fact(n - 1); }
int A::run(int a)
{
  go<int>(a); std::sort(a); while (a) {}
}
"""
R = """x <- read(1)
library(httr); require("dplyr")
f <- function(a) {
  g(h(a)); httr::GET(a); if (a) 1
}
"""


def test_line_frontends(spark):
    """Deeper lets are no declarations, recursive calls are calls, and calls outside functions belong to the file."""
    rows = [("s/a.fs", "fsharp", FSHARP), ("s/b.cpp", "cpp", CPP), ("s/c.R", "r", R), ("s/d.R", "r", "")]
    facts = line_frontends.extract(spark.createDataFrame(rows, "path string, language string, text string")).collect()
    of = lambda path, kind: sorted((r.line, r.column, r.namespace, r["class"], r.name) for r in facts if r.path == path and r.fact == kind)
    assert of("s/a.fs", "dependency") == [(1, 11, "Shop.Core", "Core", "Shop.Core"), (2, 11, "Shop.Core", "Core", "System.Math"), (9, 8, "Shop.Tools", "Tools", "Shop.Tools")]
    assert of("s/a.fs", "method") == [(3, 5, "Shop.Core", "Core", "before"), (5, 17, "Shop.Core", "Cart", "Total"), (8, 17, "Shop.Core", "Cart", "Clear"), (10, 9, "Shop.Tools", "Tools", "run")]
    calls = {(r.line, r.column, r.name, r.detail) for r in facts if r.path == "s/a.fs" and r.fact == "call"}
    assert {(7, 9, "printfn", "Total"), (8, 29, "reset", "Clear"), (11, 26, "go", "run")} <= calls and not any(line in (1, 2, 4, 6, 9) for line, *_ in calls)
    assert of("s/b.cpp", "method") == [(1, 1, "C++", "b", "translation_unit"), (3, 5, "C++", "b", "fact"), (4, 8, "C++", "A", "run")]
    assert {(r.line, r.column, r.name, r.detail) for r in facts if r.path == "s/b.cpp" and r.fact == "call"} == {
        (2, 1, "setup", "translation_unit"), (3, 42, "fact", "fact"), (6, 3, "go", "run"), (6, 15, "std::sort", "run")}
    assert of("s/c.R", "dependency") == [(2, 1, "R", "c", "httr"), (2, 16, "R", "c", "dplyr")]
    assert of("s/c.R", "method") == [(1, 1, "R", "c", "script"), (3, 1, "R", "c", "f")] and of("s/d.R", "method") == [(1, 1, "R", "d", "script")]
    assert {(r.line, r.column, r.name, r.detail) for r in facts if r.path == "s/c.R" and r.fact == "call"} == {(1, 6, "read", "script"), (4, 3, "g", "f"), (4, 5, "h", "f"), (4, 12, "httr::GET", "f")}


def test_packages_and_archives(spark):
    import io
    import zipfile

    doc = '{"libraries":{"My.Lib/1.2":{"type":"package"},"App/1":{"type":"project"}},"targets":{"net8":{"My.Lib/1.2":{"compile":{"lib/My.Lib.dll":"{}"},"runtime":{}}}}}'
    got = files.packages(spark.createDataFrame([("a", doc), ("b", "{broken")], "path string, text string")).collect()
    assert [(r.name, r.purl, r.assembly, r.alias) for r in got] == [("My.Lib", "pkg:nuget/My.Lib@1.2", "My.Lib", "Lib")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("lib/a.cs", "x")
        z.writestr("../up.cs", "x")
        z.writestr("a.nuspec", "x")
    archives = spark.createDataFrame([("p.nupkg", bytearray(data.getvalue())), ("bad", bytearray(b"no"))], "path string, content binary")
    assert [r.path for r in files.archive_entries(archives).collect()] == ["lib/a.cs"]
    assert not files.is_managed(b"MZ") and not files.is_managed(None)


def test_exports(spark):
    nodes = spark.createDataFrame([("b", 'x"<\n'), ("a", "A")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "call"), ("a", "zz", "call")], "source_id string, target_id string, label string")
    chart = exports.document(exports.mermaid(nodes, edges))
    assert chart.startswith("flowchart LR\n") and 'n2["x#quot;< "]' in chart and chart.count("-->") == 1
    for made in (exports.graphml(nodes, edges), exports.gexf(nodes, edges)):
        assert len(list(ET.fromstring(exports.document(made).encode()).iter())) > 5
    with pytest.raises(ValueError):
        exports.graph_format("png")


def test_rules(spark, tmp_path):
    assert len(rules.rule_rows(["data"])) == 28 + 28 + 5 + 6 + 5
    (tmp_path / "r.json").write_text('{"Sources":[{"kind":"Name","pattern":"abc","match":"Suffix","category":"c"}],"sinks":[]}')
    own = rules.user_rules(spark, str(tmp_path / "r.json"))
    got = rules.matched(spark.createDataFrame([(1, "XABC"), (2, "ab")], "i int, n string"), {"Name": "n"}, rules.rules(spark, ["data"], own))
    assert [r.i for r in got.collect()] == [1]


def test_merges(spark):
    rows = spark.createDataFrame([(1, 1, " ", True), (1, 2, "a", False), (1, 3, "b", True)], "k int, ord int, v string, f boolean")
    got = aggregates.merge_first_non_blank(rows, ["k"], ["v"], "ord", ("f",)).first()
    assert (got.v, got.f) == ("a", False)
    lists = spark.createDataFrame([([["a", "b"], ["b", "c"]],)], "x array<array<string>>")
    assert lists.select(aggregates.guards("x", True).alias("y")).first().y == ["b"]
    assert lists.select(aggregates.guards("x", False).alias("y")).first().y == ["a", "b", "c"]


def test_dependencies_of_all_orders(spark, tmp_path):
    orders, items = [(k, k % 23) for k in range(60)], [(k * 7 % 60, k % 31) for k in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    expected = {}
    for order, customer in orders:
        for part in (p for o, p in items if o == order):
            expected.setdefault(f"op{customer}", set()).add(f"p{part}")
    got = {r.operation_id: r.depends_on for r in queries.QUERIES["cbom_dependencies"](spark, str(tmp_path)).collect()}
    assert got == {k: ",".join(sorted(v)) for k, v in expected.items()} and len(got) == 23


def test_long_chains_are_walked_to_their_ends(spark, monkeypatch):
    # levels are kept as local rows, for speed
    monkeypatch.setattr(graph, "stored", lambda df: spark.createDataFrame(df.collect(), df.schema).coalesce(1))
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(103)], "source_id string, target_id string").coalesce(1)
    got = {(r.id, r.depth) for r in graph.reach(edges, spark.createDataFrame([("0",)], "id string").coalesce(1)).collect()}
    assert got == {(str(k), k) for k in range(104)}
