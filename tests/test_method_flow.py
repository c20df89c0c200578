"""Data flow of C# and Visual Basic files, from the files to the slices."""

import json

import pytest

from factloom import cli
from factloom.operators import method_flow


def program(body, more=""):
    return f"using System.Diagnostics;\nusing System.IO;\nusing System.Text.RegularExpressions;\n\nclass Program\n{{\n    static void Main(string[] args)\n    {{\n{body}\n    }}\n{more}}}\n"


FILES = {
    "Cli.cs": program("        var command = args[0];\n        Process.Start(command);"),
    "Between.cs": program("        Launch(args[0]);", "    static void Launch(string what)\n    {\n        Process.Start(what);\n    }\n"),
    "Sanitized.cs": program('        var guarded = args[0];\n        if (Regex.IsMatch(guarded, "^[a-z]+$"))\n        {\n            Process.Start(guarded);\n        }'),
    "Read.cs": program("        var path = args[0];\n        File.ReadAllText(path);"),
    "Killed.cs": program('        var a = args[0];\n        a = "safe";\n        Process.Start(a);'),
    "Clean.cs": program('        Process.Start("ls");'),
    "Text.cs": program('        var a = $"-c {args[0]}";\n        Process.Start("sh", a);'),
    "Module.vb": "Imports System.Diagnostics\nModule Tool\n    Sub Main(args As String())\n        Dim command As String = args(0)\n        Process.Start(command)\n    End Sub\nEnd Module\n",
    "a.R": "cmd <- commandArgs()\nsystem(cmd)\n",
    "Empty.cs": "",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    for name, text in FILES.items():
        (folder / name).write_text(text)
    return cli.dataflows(spark, str(folder)), folder


def test_files_to_slices(tables):
    rows = tables[0]["slices"].collect()
    got = {(r.path.rsplit("/", 1)[1], r.source_category, r.sink_category, r.argument_index, r.through is not None) for r in rows}
    assert got == {
        ("Cli.cs", "cli", "command", 0, False), ("Between.cs", "cli", "command", 0, True), ("Read.cs", "cli", "file", 0, False),
        ("Text.cs", "cli", "command", 1, False), ("Module.vb", "cli", "command", 0, False), ("a.R", "r-input", "command", None, False),
    }


def test_every_end_is_a_node(tables):
    ids = {r.id for r in tables[0]["nodes"].collect()}
    assert all({r.source_id, r.target_id} <= ids for r in tables[0]["edges"].collect()) and ids


def test_report_and_diff(spark, tables, tmp_path):
    said = cli.report(spark, str(tables[1] / "Cli.cs"))
    assert "- slices: 1" in said and "CWE-78" in said
    one = {"source_category": "cli", "sink_category": "command", "sink_argument": "a"}
    for name, rows in (("old", [one]), ("new", [one | {"sink_argument": "b"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"slices": rows}))
    got = {tuple(r) for r in cli.diff(spark, str(tmp_path / "old.json"), str(tmp_path / "new.json")).collect()}
    assert got == {("added", "cli->command:b"), ("removed", "cli->command:a")}


CHECKS = {"Sink": [("Run(", "command")], "Sanitizer": [("Ok(", "validation")], "Source": []}


@pytest.mark.parametrize("code, expected", [
    ("if (!Ok(a)) return;\nRun(a);", []),
    ("if (!Ok(a))\n{\nreturn;\n}\nRun(a);", []),
    ("if (Ok(a)) {\nx();\n} else {\nRun(a);\n}", [("a", 0)]),
    ("if (!Ok(a)) {\nRun(a);\n} else {\nRun(a);\n}", [("a", 0)]),
    ("if (Ok(a) || b)\n{\nRun(a);\n}", [("a", 0)]),
    ("if (Ok(a) && b)\n{\nRun(a);\n}", []),
    ("if (Ok(a))\n{\nRun(a);\n}\nRun(a);", [("a", 0)]),
    ("if (Ok(a)) Run(a);\nRun(b, a);", [("a", 1)]),
    ("var c = Ok(a);\nRun(c);", []),
    ("box.Value = a;\nRun(box.Other);\nRun(box.Value);", [("box.Value", 0)]),
])
def test_guards(code, expected):
    rows = list(enumerate(code.split("\n"), 1))
    out = method_flow.follow(rows, {"a": [("source", 0, "cli")]}, CHECKS)
    assert [(x[6], x[7]) for x in out if x[3] == "sink"] == expected


def test_arguments_and_conditions():
    assert method_flow.arguments('f(a, b), "x, y", c[1, 2]) + d') == ["f(a, b)", '"x, y"', "c[1, 2]"]
    assert method_flow.guarded_names("(Ok(a) || Ok(a, b)) && !Ok(c)", ["Ok("])[0] >= {"a"}
    assert "c" not in method_flow.guarded_names("Ok(a) && !Ok(c)", ["Ok("])[0]
