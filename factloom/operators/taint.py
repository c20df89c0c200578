"""Line taint (W5, G21, P7, P8) and the statement kernel of a method."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Input tokens of line languages, in order.
LINE_SOURCES = {
    "r": ("input$", "req$", "commandArgs", "Sys.getenv", "fileInput"),
    "fsharp": ("Request.Query", "Request.Form", "Request.Body", "HttpContext", "argv", "Console.ReadLine"),
    "cpp": ("argv", "getenv", "std::cin", "recv(", "ReadFile", "InternetReadFile"),
}
SOURCE_CATEGORIES = {"r": "r-input", "fsharp": "fsharp-input", "cpp": "native-input"}
#: Sink tokens of line languages and their categories, in order.
LINE_SINKS = {
    "r": (
        ("system(", "command"), ("system2(", "command"), ("shell(", "command"), ("eval(", "eval"), ("parse(", "eval"),
        ("dbGetQuery", "sql"), ("dbExecute", "sql"), ("httr::GET", "network"), ("download.file", "network"),
    ),
    "fsharp": (("Process.Start", "command"), ("SqlCommand", "sql"), ("File.", "file"), ("HttpClient", "network"), ("Deserialize", "deserialization")),
    "cpp": (
        ("system(", "command"), ("popen(", "command"), ("CreateProcess", "command"), ("SQLExecDirect", "sql"),
        ("strcpy", "memory"), ("sprintf", "memory"), ("EVP_DecryptInit", "crypto"), ("SSL_CTX_set_verify", "tls"),
    ),
}
#: The assigned name of a line by language.
ASSIGNED = {
    "r": r"\b([A-Za-z_][\w.]*)\s*(?:<-|=)",
    "fsharp": r"\blet\s+(?:mutable\s+)?([A-Za-z_][\w']*)\s*=",
    "cpp": r"\b(?:auto|char\*|std::string|string|const\s+char\*)?\s*([A-Za-z_][\w]*)\s*=",
}


def _first(table: dict, language: str, value):
    """The first token of a language that a line holds in any case, as a struct."""
    out = F.lit(None)
    for key, tokens in table.items():
        for token in reversed(tokens):
            name = token if isinstance(token, str) else token[0]
            hit = (F.col(language) == key) & F.contains(F.lower("code"), F.lit(name.lower()))
            out = F.when(hit, F.struct(F.lit(name).alias("token"), F.lit(value(key, token)).alias("category"))).otherwise(out)
    return out


def mark_lines(rows: DataFrame, language: str = "language") -> DataFrame:
    """source_token, source_category, sink_token, sink_category and assigned of each line."""
    assigned = F.lit(None).cast("string")
    for key, pattern in ASSIGNED.items():
        assigned = F.when(F.col(language) == key, F.regexp_extract("code", pattern, 1)).otherwise(assigned)
    out = rows.withColumns({
        "_s": _first(LINE_SOURCES, language, lambda k, t: SOURCE_CATEGORIES[k]), "_k": _first(LINE_SINKS, language, lambda k, t: t[1]),
        "assigned": F.when(assigned != "", assigned)})
    return out.select(*rows.columns, "assigned", F.col("_s.token").alias("source_token"), F.col("_s.category").alias("source_category"),
                      F.col("_k.token").alias("sink_token"), F.col("_k.category").alias("sink_category"))


def line_slices(marked: DataFrame, file: str = "path") -> DataFrame:
    """Sinks with each name that an earlier source line of the file assigned and that the sink's line holds.

    Names of a line meet assignments in an equi-join on file and name; the latest assignment before the sink wins.
    """
    names = F.array_distinct(F.transform(F.regexp_extract_all("code", F.lit(r"([A-Za-z_][\w.']*)"), F.lit(1)), F.lower))
    sinks = marked.filter(F.col("sink_token").isNotNull()).select(
        file, F.col("line").alias("sink_line"), "sink_category", "sink_token", F.explode(names).alias("name"))
    sources = marked.filter(F.col("source_token").isNotNull() & F.col("assigned").isNotNull()).select(
        file, F.col("line").alias("source_line"), "source_category", F.lower("assigned").alias("name"))
    pairs = sinks.join(sources, [file, "name"]).filter("source_line < sink_line")
    latest = F.row_number().over(Window.partitionBy(file, "sink_line", "name").orderBy(F.desc("source_line")))
    flows = pairs.withColumn("_n", latest).filter("_n = 1").drop("_n")
    direct = marked.filter(F.col("source_token").isNotNull() & F.col("sink_token").isNotNull()).select(
        file, F.lit(None).cast("string").alias("name"), F.col("line").alias("sink_line"), "sink_category", "sink_token", F.col("line").alias("source_line"), "source_category")
    return flows.unionByName(direct)


SLICE_SCHEMA = "method_id string, source_line int, source_category string, sink_line int, sink_category string, argument string"
_ASSIGN = re.compile(r"^\s*(?:(?:var|string|int|object|[A-Z][\w<>\[\]]*)\s+)?([A-Za-z_][\w.]*)\s*=(?!=)\s*(.+?);?\s*$")
_NAMES = re.compile(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*")


def taint_method(statements: list[tuple[int, str]], parameters: dict[str, str], sources, sinks, sanitizers) -> list[tuple]:
    """Statements of one method in order: assignments pass taint on or end it, guards and sanitizers stop it.

    Field-sensitive keys are ``receiver.member``; a guard protects the names that it tests until its block ends.
    """
    tainted = {name: (0, category) for name, category in parameters.items()}
    guarded: list[tuple[int, set[str]]] = []
    depth, out = 0, []

    def taint_of(expression: str):
        if any(s in expression for s, _ in sanitizers):
            return None
        for name in _NAMES.findall(expression):
            parts = name.split(".")
            for k in range(len(parts), 0, -1):
                key = ".".join(parts[:k])
                if key in tainted and not any(key in names for _, names in guarded):
                    return tainted[key], key
        return next((((line, c), s) for s, c in sources if s in expression), None)

    for line, code in statements:
        guarded = [(d, names) for d, names in guarded if depth >= d or d < 0]
        test = re.match(r"^\s*(?:else\s+)?if\s*\((.*)\)\s*(.*)$", code)
        if test and not test[1].lstrip().startswith("!") and any(s in test[1] for s, _ in sanitizers):
            names = {n for n in _NAMES.findall(test[1]) if n in tainted}
            guarded.append((depth + 1 if "{" in code or not test[2] else -1, names))
        for token, category in sinks:
            at = code.find(token)
            if at >= 0:
                argument = code[at + len(token) :]
                found = taint_of(argument)
                if found:
                    out.append((found[0][0], found[0][1], line, category, found[1]))
        assigned = _ASSIGN.match(code)
        if assigned and not test:
            found = taint_of(assigned[2])
            if found:
                tainted[assigned[1]] = found[0]
            else:
                tainted.pop(assigned[1], None)
        guarded = [(d, n) for d, n in guarded if d != -1]
        depth += code.count("{") - code.count("}")
    return out


def method_slices(statements: DataFrame, sources: list[tuple[str, str]], sinks: list[tuple[str, str]], sanitizers: list[tuple[str, str]]) -> DataFrame:
    """Slices per method. ``statements``: method_id, line, code, parameters (map name to category)."""

    def run(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        frame = frames.sort_values("line")
        parameters = dict(frame["parameters"].iloc[0] or {})
        rows = taint_method(list(zip(frame["line"], frame["code"], strict=True)), parameters, sources, sinks, sanitizers)
        own = frame["method_id"].iloc[0]
        return pd.DataFrame([(own, *r) for r in rows], columns=["method_id", "source_line", "source_category", "sink_line", "sink_category", "argument"])

    return statements.groupBy("method_id").applyInPandas(run, SLICE_SCHEMA)


def summaries(statements: DataFrame, sinks: list[tuple[str, str]]) -> DataFrame:
    """(method_id, parameter, item): parameters that are returned or that occur in a sink's line."""
    long = statements.select("method_id", "code", F.explode(F.map_keys("parameters")).alias("parameter"))
    used = long.filter(F.array_contains(F.regexp_extract_all("code", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)), F.col("parameter")))
    out = used.filter(F.col("code").rlike(r"^\s*return\b")).select("method_id", "parameter", F.lit("return").alias("item"))
    for token, category in sinks:
        out = out.unionByName(used.filter(F.contains(F.col("code"), F.lit(token))).select("method_id", "parameter", F.lit(f"sink:{category}").alias("item")))
    return out.distinct()


def spread_summaries(direct: DataFrame, calls: DataFrame, rounds: int = 3) -> DataFrame:
    """Callee summaries carried to callers, at most ``rounds`` times (the bound is the feature).

    ``calls``: method_id (the caller), parameter, callee_id, callee_parameter.
    """
    known = direct.select("method_id", "parameter", "item")
    for _ in range(rounds):
        lifted = calls.join(known.select(F.col("method_id").alias("callee_id"), F.col("parameter").alias("callee_parameter"), "item"), ["callee_id", "callee_parameter"])
        lifted = lifted.filter(F.col("item") != "return").select("method_id", "parameter", "item")
        known = known.unionByName(lifted).distinct()
    return known
