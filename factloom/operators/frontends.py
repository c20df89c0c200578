"""Tolerant per-file extraction (E1-E14, E20): declarations, calls, imports and endpoints.

Extraction is lexical: regular expressions over lines, in built-in functions for the line languages (line_frontends) and
in one Arrow function per file where blocks have to be followed. Names are bound afterwards, by joins (see joins.unique_candidate).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import ATTRIBUTE_VERBS, MAPPING_VERBS
from factloom.functions.text import urls
from factloom.operators import line_frontends
from factloom.operators.line_frontends import FACTS

#: Words that are no names in C#.
WORDS = frozenset("if for while switch return catch using lock new function else match with then let in do sizeof foreach fun when and or not true false library require nameof typeof".split())

_MODIFIERS = r"(?:public|private|protected|internal|static|sealed|virtual|override|async|abstract|partial|extern|readonly|unsafe|new|const|event|required)"
CS_TYPE = re.compile(rf"^\s*(?:\[[^\]]*\]\s*)*(?:{_MODIFIERS}\s+)*(?:class|struct|interface|record|enum)\s+(\w+)")
CS_METHOD = re.compile(rf"^\s*(?:\[[^\]]*\]\s*)*(?P<m>(?:{_MODIFIERS}\s+)*)(?:(?P<type>[\w<>\[\],.?]+)\s+)?(?P<name>\w+)\s*(?:<[^>(]*>)?\s*\((?P<args>[^;{{]*)\)\s*(?:where\s.*)?(?::\s*(?:base|this)\s*\(.*\))?\s*(?:\{{|=>|$)")
CS_FIELD = re.compile(rf"^\s*(?:\[[^\]]*\]\s*)*(?P<m>(?:{_MODIFIERS}\s+)+)(?P<type>[\w<>\[\],.?]+)\s+(?P<name>\w+)\s*(?P<tail>[;={{]|=>)")
VB_METHOD = re.compile(r"^\s*(?:<[^>]*>\s*)*(?:(?:Public|Private|Protected|Friend|Shared|Overrides|Overridable|MustOverride|Async|NotOverridable|Shadows)\s+)*(?:Sub|Function)\s+(\w+)\s*\(([^)]*)\)", re.I)
CALL = re.compile(r"(?:(?P<new>\bnew\s+))?(?P<name>[A-Za-z_][\w.]*)\s*(?:<[\w<>, ]+>)?\(")


def _csharp(lines: list[str]) -> Iterator[tuple]:
    space, types, depth, member = "", [], 0, None
    for n, line in enumerate(lines, 1):
        code = re.sub(r"//.*$", "", re.sub(r'"(?:\\.|[^"\\])*"', '""', line))
        if found := re.match(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", code):
            yield "dependency", space, None, found[1], None, n, line.find(found[1]) + 1
        elif found := re.match(r"^\s*namespace\s+([\w.]+)", code):
            space = found[1]
        elif found := CS_TYPE.match(code):
            types.append((depth, found[1]))
            yield "type", space, found[1], found[1], None, n, line.find(found[1]) + 1
        elif types and depth == types[-1][0] + 1 and (found := CS_METHOD.match(code)) and found["name"] not in WORDS and (found["m"] or found["type"]):
            owner = types[-1][1]
            kind = "constructor" if found["name"] == owner and not found["type"] else "method"
            member = found["name"]
            yield kind, space, owner, member, found["args"].strip(), n, line.find(member) + 1
        elif types and depth == types[-1][0] + 1 and (found := CS_FIELD.match(code)):
            owner = types[-1][1]
            kind = "event" if re.search(r"\bevent\b", found["m"]) or found["type"] == "event" else "property" if found["tail"] in ("{", "=>") else "field"
            yield kind, space, owner, found["name"], found["type"], n, line.find(found["name"]) + 1
            if kind == "property":  # accessors are methods too
                for accessor in ("get", "set"):
                    if re.search(rf"\b{accessor}\b", code) or accessor == "get" and "=>" in code:
                        yield "method", space, owner, f"{accessor}_{found['name']}", "", n, line.find(found["name"]) + 1
        elif member is not None and types:
            for call in CALL.finditer(code):
                if call["name"].split(".")[-1] not in WORDS:
                    yield "constructor_call" if call["new"] else "call", space, types[-1][1], call["name"], member, n, call.start("name") + 1
        depth += code.count("{") - code.count("}")
        while types and depth <= types[-1][0] and "}" in code:
            types.pop()


def _vb(lines: list[str]) -> Iterator[tuple]:
    space, owner, member = "", None, None
    for n, line in enumerate(lines, 1):
        if found := re.match(r"^\s*Imports\s+([\w.]+)", line, re.I):
            yield "dependency", space, None, found[1], None, n, line.find(found[1]) + 1
        elif found := re.match(r"^\s*Namespace\s+([\w.]+)", line, re.I):
            space = found[1]
        elif found := re.match(r"^\s*(?:(?:Public|Friend|Partial|MustInherit|NotInheritable)\s+)*(?:Class|Module|Structure|Interface)\s+(\w+)", line, re.I):
            owner = found[1]
            yield "type", space, owner, owner, None, n, line.find(owner) + 1
        elif found := VB_METHOD.match(line):
            member = found[1]
            yield "constructor" if member.lower() == "new" else "method", space, owner, member, found[2].strip(), n, line.find(member) + 1
        elif found := re.match(r"^\s*(?:(?:Public|Private|Protected|Friend|Shared|ReadOnly|Default)\s+)+Property\s+(\w+)", line, re.I):
            yield "property", space, owner, found[1], None, n, line.find(found[1]) + 1
        elif member:
            for call in CALL.finditer(re.sub(r'"[^"]*"', '""', line)):
                yield "call", space, owner, call["name"], member, n, call.start("name") + 1


FRONTENDS = {"csharp": _csharp, "vb": _vb}


def extract(files: DataFrame) -> DataFrame:
    """Facts of ``files`` (path, language, text); a file that can't be parsed gives no rows and raises nothing."""
    return _block_facts(files.filter(F.col("language").isin(*FRONTENDS))).unionByName(line_frontends.extract(files))


def _block_facts(files: DataFrame) -> DataFrame:
    """C# and Visual Basic, whose blocks need a running depth."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in FACTS.split(", ")]
        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"], strict=True):
                parse = FRONTENDS.get(language)
                if parse is not None and text:
                    rows += [(path, language, *fact) for fact in parse(text.splitlines())]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "language", "text").mapInPandas(run, FACTS)


def endpoints(files: DataFrame) -> DataFrame:
    """Endpoints from attributes (with the class's route) and mapping calls, and their authorization."""
    columns = ["path", "kind", "verb", "route", "method", "line", "requires_auth", "allows_anonymous", "policies", "roles"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                rows += [(path, *x) for x in parse_endpoints(text or "")]
            yield pd.DataFrame(rows, columns=columns)

    schema = "path string, kind string, verb string, route string, method string, line int, requires_auth boolean, allows_anonymous boolean, policies string, roles string"
    return files.select("path", "text").mapInPandas(run, schema)


def parse_endpoints(text: str) -> Iterator[tuple]:
    route_of_class, pending, class_auth = "", [], []
    for n, line in enumerate(text.splitlines(), 1):
        attributes = re.findall(r"(?:^|[\[<,])\s*(\w+)\s*(?:\(([^)\]]*)\))?\s*(?=[\],>])", line) if re.match(r"^\s*[\[<]", line) else []
        pending += attributes
        if re.search(r"\bclass\s+\w+", line, re.I):
            route_of_class = next((_quoted(a) for k, a in pending if k == "Route"), "")
            class_auth, pending = [x for x in pending if x[0] in ("Authorize", "AllowAnonymous")], []
        elif (method := re.search(r"(\w+)\s*\([^;]*\)\s*(?:\{|=>|$|As\b)", line)) and pending and not line.lstrip().startswith(("[", "<")):
            auth = class_auth + pending
            for kind, argument in pending:
                verb = ATTRIBUTE_VERBS.get(kind.lower().removesuffix("attribute")) or ("ANY" if kind == "Route" else None)
                if verb:
                    own = _quoted(argument)
                    both = own if not route_of_class else route_of_class if not own else f"{route_of_class.rstrip('/')}/{own.lstrip('/')}"
                    yield ("controller", verb, both, method[1], n, *_auth(auth))
            pending = []
        for call in re.finditer(r"\.(Map\w+)\s*\(\s*\"([^\"]*)\"", line):
            if call[1] in MAPPING_VERBS:
                anonymous = ".AllowAnonymous(" in line
                policy = re.search(r"\.RequireAuthorization\(\s*(?:\"([^\"]*)\")?", line)
                yield "minimal", MAPPING_VERBS[call[1]], call[2], None, n, None if policy is None and not anonymous else policy is not None, anonymous, policy[1] if policy else None, None


def _quoted(argument: str) -> str:
    found = re.search(r'"([^"]*)"', argument or "")
    return found[1] if found else ""


def _auth(attributes: list[tuple[str, str]]) -> tuple:
    needs = [a for k, a in attributes if k == "Authorize"]
    policies = sorted({m for a in needs for m in re.findall(r'Policy\s*=\s*"([^"]*)"', a) + re.findall(r'^\s*"([^"]*)"', a)})
    roles = sorted({r.strip() for a in needs for m in re.findall(r'Roles\s*=\s*"([^"]*)"', a) for r in m.split(",")})
    return bool(needs) or None, any(k == "AllowAnonymous" for k, _ in attributes), ",".join(policies) or None, ",".join(roles) or None


def file_urls(files: DataFrame) -> DataFrame:
    """(path, url), each once per file."""
    return files.select("path", F.explode(urls(F.col("text"))).alias("url"))


def entry_points(facts: DataFrame, ends: DataFrame) -> DataFrame:
    """Entry points from endpoints and from methods named Main, in order of file and line."""
    main = facts.filter((F.col("fact") == "method") & (F.col("name") == "Main")).select(
        "path", "line", F.lit("cli").alias("kind"), F.col("name").alias("method"), F.lit(None).cast("string").alias("route"))
    web = ends.select("path", "line", F.lit("http").alias("kind"), "method", "route")
    return web.unionByName(main)
