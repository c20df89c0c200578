"""Data flow of C# and Visual Basic files (P5, P6, G4-G11): from parameters and input expressions to sinks, over calls.

Rules meet parameters and calls in joins (a call's name is tried as it stands and below each import of its file). One
Arrow function follows each method's statements in order; what it finds for calls is joined to the callees' summaries.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import rules as rule_tables
from factloom.operators.frontends import CALL, WORDS
from factloom.operators.graph import stored

METHOD = ["path", "method_id"]
REACHED = "path string, method_id string, source_kind string, source_line int, source string, sink_kind string, sink_line int, sink string, argument string, argument_index int, arity int"
_ASSIGN = re.compile(r"^\s*(?:(?:Dim\s+)?(?!return\b)(?:[\w.]+(?:<[\w<>, .]*>)?(?:\[\])?\??\s+)?)([A-Za-z_][\w.]*)(?:\s+As\s+[\w.]+)?\s*=(?![=>])\s*(.+?);?\s*$", re.I)
_NAME = re.compile(r"(?<![\w.])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")
_QUOTED = re.compile(r'\$?"(?:\\.|[^"\\])*"')
_IF = re.compile(r"^\s*(?:\}\s*)?(?P<else>else\s*)?if\b\s*(?P<rest>.*)$", re.I)


def parameters(facts: DataFrame) -> DataFrame:
    """A row per parameter: path, method_id, method, class, line, arity, position, parameter, type, attributes."""
    out = facts.filter(F.col("fact").isin("method", "constructor") & F.col("language").isin("csharp", "vb"))
    # Commas within angle brackets, brackets or parentheses separate no parameters.
    parts = F.filter(F.split(F.coalesce("detail", F.lit("")), r",(?![^<]*>)(?![^\[]*\])(?![^(]*\))"), lambda x: F.trim(x) != "")
    out = out.select("path", "language", method_id().alias("method_id"), F.col("name").alias("method"), F.col("class"), "line", F.size(parts).alias("arity"), F.posexplode_outer(parts).alias("position", "_p"))
    text = F.regexp_replace(F.regexp_replace("_p", r"^\s*(?:(?:\[[^\]]*\]|<[^>]*>)\s*)+", ""), r"\s*=.*$", "")
    vb, bare = F.col("language") == "vb", F.trim(F.regexp_replace(text, r"^\s*(?:(?:this|ref|out|in|params|scoped)\s+)+", ""))
    return out.select(
        "path", "method_id", "method", "class", "line", "arity", "position",
        F.when(vb, F.regexp_extract(text, r"(?i)(\w+)\s*(?:\(\))?\s*(?:As\b.*)?$", 1)).otherwise(F.regexp_extract(bare, r"(\w+)\s*$", 1)).alias("parameter"),
        F.when(vb, F.regexp_extract(text, r"(?i)\bAs\s+(.+)$", 1)).otherwise(F.trim(F.regexp_replace(bare, r"\w+\s*$", ""))).alias("type"),
        F.regexp_extract_all("_p", F.lit(r"[\[<]\s*(\w+)"), F.lit(1)).alias("attributes"))


def method_id() -> Column:
    return F.concat_ws(":", F.concat_ws(".", "namespace", "class", "name"), F.col("line").cast("string"))


def parameter_sources(found: DataFrame, table: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """P5: the first rule that a parameter fits by name, by name and type, by type or by attribute; ``args`` of Main as ``Main``.

    ``attributes``: path, method_id, attribute of methods.
    """
    key = ["path", "method_id", "position"]
    known = found.filter(F.col("parameter") != "")
    main = F.when((F.col("method") == "Main") & (F.lower("parameter") == "args"), F.lit("Main"))
    of = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("_text"))
    texts = F.concat(
        F.array(of("Parameter", F.col("parameter")), of("Parameter", F.concat_ws(" ", "parameter", "type")), of("Parameter", main), of("Type", F.col("type"))),
        F.transform("attributes", lambda x: of("Attribute", x)))
    long = known.select(*key, "parameter", F.explode(texts).alias("_t")).select(*key, "parameter", "_t.kind", "_t._text")
    if attributes is not None:
        long = long.unionByName(known.join(attributes, METHOD).select(*key, "parameter", F.lit("Attribute").alias("kind"), F.col("attribute").alias("_text")))
    hits = long.join(table.filter("target = 'Source'"), "kind").filter(rule_tables.matches(F.col("match"), F.col("pattern"), F.col("_text")))
    return hits.groupBy(*key, "parameter").agg(F.min_by("category", "ord").alias("category"))


def statements(files: DataFrame, facts: DataFrame) -> DataFrame:
    """The lines of each file with the member that was declared last; the declaration itself only behind its arrow."""
    from factloom.functions.text import lines

    starts = facts.filter(F.col("fact").isin("method", "constructor", "type")).select(
        "path", "line", F.when(F.col("fact") != "type", method_id()).alias("_id")).groupBy("path", "line").agg(F.max("_id").alias("_id"))
    rows = lines(files.select("path", "language", "text")).join(starts.withColumn("_starts", F.lit(True)), ["path", "line"], "left")
    last = F.last(F.when(F.col("_starts"), F.struct("_id")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    rows = rows.withColumn("method_id", last["_id"]).filter("method_id IS NOT NULL")
    code = F.when(F.col("_starts"), F.regexp_extract("code", r"\)\s*=>\s*(.*)$", 1)).otherwise(F.col("code"))
    return rows.select("path", "language", "method_id", "line", code.alias("code"))


def operation_rules(rows: DataFrame, facts: DataFrame, table: DataFrame) -> DataFrame:
    """(path, method_id, target, token, category): calls, types, members and code that rules of a target fit, first rule first.

    A name is tried as it stands and below each import of its file.
    """
    imports = facts.filter("fact = 'dependency'").groupBy("path").agg(F.collect_set("name").alias("imports"))
    names = F.array_distinct(F.regexp_extract_all("code", F.lit(r"((?:\bnew\s+)?[A-Za-z_][\w.]*\(?)"), F.lit(1)))
    used = rows.select(*METHOD, F.explode(names).alias("token")).distinct().join(imports, "path", "left")
    bare = F.regexp_replace("token", r"^new\s+|\($", "")
    full = F.concat(F.array(bare), F.transform(F.coalesce("imports", F.array().cast("array<string>")), lambda x: F.concat(x, F.lit("."), bare)))
    last, called, new = F.element_at(F.split(bare, r"\."), -1), F.endswith("token", F.lit("(")), F.startswith("token", F.lit("new "))
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("_text"))
    none = F.array().cast("array<struct<kind:string,_text:string>>")
    every = lambda kind, when: F.when(when, F.transform(full, lambda x: of(kind, x))).otherwise(none)
    texts = F.concat(every("Method", called), every("Type", new), every("Symbol", F.lit(True)), F.array(of("Name", last), of("Code", F.col("token"))))
    long = used.select(*METHOD, "token", F.explode(F.array_distinct(texts)).alias("_t")).select(*METHOD, "token", "_t.kind", "_t._text")
    codes = table.filter("kind = 'Code'")
    hits = long.join(table.filter("kind NOT IN ('Parameter', 'Attribute', 'Code')"), "kind").filter(rule_tables.matches(F.col("match"), F.col("pattern"), F.col("_text")))
    # Code rules may hold signs that no name has: they are tried on whole lines, and their pattern is the token.
    lines = rows.withColumn("kind", F.lit("Code")).join(codes, "kind").filter(rule_tables.matches(F.col("match"), F.col("pattern"), F.col("code")))
    hits = hits.select(*METHOD, "target", "token", "category", "ord").unionByName(lines.select(*METHOD, "target", F.col("pattern").alias("token"), "category", "ord"))
    return hits.groupBy(*METHOD, "target", "token").agg(F.min_by("category", "ord").alias("category"))


def _plain(text: str) -> str:
    """The text without quoted parts; of interpolated ones the expressions stay."""
    return _QUOTED.sub(lambda m: " ".join(re.findall(r"\{([^{}]*)\}", m[0])) if m[0].startswith("$") else '""', text)


def _at(token: str, text: str) -> int:
    """Where a text holds a token in any case, a word at its start being whole; -1 if nowhere."""
    found = re.search((r"(?<![\w])" if token[:1].isalnum() else "") + re.escape(token), text, re.I)
    return found.start() if found else -1


def arguments(text: str) -> list[str]:
    """The arguments of a call, from behind its opening parenthesis to the closing one."""
    out, depth, start = [], 0, 0
    masked = _QUOTED.sub(lambda m: "_" * len(m[0]), text)
    for at, sign in enumerate(masked):
        if sign in "([{":
            depth += 1
        elif sign in ")]}":
            if depth == 0:
                return [x for x in [*out, text[start:at].strip()] if x]
            depth -= 1
        elif sign == "," and depth == 0:
            out.append(text[start:at].strip())
            start = at + 1
    return [x for x in [*out, text[start:].strip()] if x]


def _top(condition: str, signs: tuple[str, ...]) -> list[str]:
    """The condition's parts at a connective that stands in no parentheses."""
    parts, depth, start, at = [], 0, 0, 0
    masked = _QUOTED.sub(lambda m: "_" * len(m[0]), condition)
    while at < len(masked):
        depth += (masked[at] == "(") - (masked[at] == ")")
        sign = next((s for s in signs if depth == 0 and masked[at : at + len(s)].lower() == s), None)
        if sign:
            parts.append(condition[start:at])
            at = start = at + len(sign)
        else:
            at += 1
    return [*parts, condition[start:]]


def guarded_names(condition: str, sanitizers: list[str]) -> tuple[set[str], set[str]]:
    """Names that a condition vouches for where it holds, and where it doesn't."""
    condition = condition.strip()
    for signs, merge, other in ((("||", " orelse ", " or "), set.intersection, set.union), (("&&", " andalso ", " and "), set.union, set.intersection)):
        parts = _top(condition, signs)
        if len(parts) > 1:
            both = [guarded_names(p, sanitizers) for p in parts]
            return merge(*[b[0] for b in both]), other(*[b[1] for b in both])
    if found := re.match(r"^(?:!|not\b)(.*)$", condition, re.I | re.S):
        return guarded_names(found[1], sanitizers)[::-1]
    if condition.startswith("(") and not _closing(condition)[1].strip():
        return guarded_names(_closing(condition)[0], sanitizers)
    if any(_at(s, condition) >= 0 for s in sanitizers):
        return set(_NAME.findall(_plain(condition))), set()
    return set(), set()


def follow(rows: list[tuple[int, str]], seeds: dict[str, list[tuple]], marks: dict[str, list[tuple[str, str]]], vb: bool = False) -> list[tuple]:
    """G4-G7, G10, G11 over a method's statements in order.

    ``seeds``: parameter to its origins (kind, line, source). ``marks``: (token, category) of Source, Sink and Sanitizer.
    Gives (kind, line, source, sink kind, line, sink, argument, index, arity); index -1 is the receiver. An assignment
    passes taint on, or ends it; a name behind a guard is clean in the guarded branch, and after a branch that leaves.
    """
    tainted, out, depth = {k: list(v) for k, v in seeds.items()}, [], 0
    sanitizers = [t for t, _ in marks.get("Sanitizer", ())]
    guards: list[tuple[int, set[str]]] = []  # from a depth on
    closed: dict[int, set[str]] = {}  # what the else-branch of the last condition at a depth may trust
    waiting: set[str] | None = None  # of a condition whose branch starts on the next line
    leaving: set[str] | None = None

    def taint_of(text: str) -> list[tuple]:
        if any(_at(s, text) >= 0 for s in sanitizers):
            return []
        clean = {n for _, names in guards for n in names}
        for name in _NAME.findall(_plain(text)):
            parts = name.split(".")
            for k in range(len(parts), 0, -1):
                key = ".".join(parts[:k])
                if key in tainted:
                    if key not in clean:
                        return tainted[key]
                    break
        return [("source", line, c) for t, c in marks.get("Source", ()) if _at(t, text) >= 0][:1]

    for line, raw in rows:
        code = re.sub(r"\s//.*$|^//.*$", "", raw) if not vb else raw
        bare = _QUOTED.sub('""', code)
        test, once = _IF.match(code), None
        body = code
        if vb and re.match(r"^\s*End\s+If\b", code, re.I) or vb and re.match(r"^\s*Else(If)?\b", code, re.I):
            depth -= 1
        opened = bare.lstrip().startswith("{")
        if bare.lstrip().startswith("}"):
            guards = [(d, n) for d, n in guards if d < depth]
        else:
            guards = [(d, n) for d, n in guards if d <= depth]
        if waiting is not None and code.strip():
            guards.append((depth + 1 if opened else depth, waiting))
            once = None if opened else waiting
            waiting = None
        level = depth - bare.lstrip().startswith("}")
        if test:
            rest = test["rest"]
            if vb:
                found = re.match(r"^(.*?)\s+Then\b\s*(.*)$", rest, re.I)
                condition, body = (found[1], found[2]) if found else (rest, "")
            else:
                parts = _closing(rest)
                condition, body = parts
            holds, fails = guarded_names(condition, sanitizers)
            if test["else"]:
                holds = holds | closed.get(level, set())
            closed[level] = fails
            inner = body.strip()
            if inner in ("", "{"):
                if vb or inner == "{":
                    guards.append((level + 1, holds))
                else:
                    waiting = holds
                leaving = fails
            else:
                once = holds
                guards.append((depth, holds))
                if re.match(r"^\{?\s*(return|throw|continue|break|exit)\b", inner, re.I):
                    tainted = {k: v for k, v in tainted.items() if k not in fails}
        elif re.match(r"^\s*\}?\s*else\b", code, re.I):
            trusted = closed.get(level, set())
            body = re.sub(r"^\s*\}?\s*else\b", "", code, flags=re.I)
            if vb or body.strip() == "{":
                guards.append((level + 1, trusted))
            elif not body.strip():
                waiting = trusted
            else:
                once = trusted
                guards.append((depth, trusted))
        elif leaving and re.match(r"^\s*(return|throw|exit)\b", code, re.I):
            tainted = {k: v for k, v in tainted.items() if k not in leaving}  # behind the branch, what its condition's failure vouches for
            leaving = None
        elif bare.strip() not in ("", "{"):
            leaving = None
        for sink, category in marks.get("Sink", ()):
            at = _at(sink, body)
            if at < 0:
                continue
            given = arguments(body[at + len(sink) :]) if sink.endswith("(") else [body[at + len(sink) :]]
            receiver = re.sub(r"^new\s+", "", sink[:-1]).rpartition(".")[0] if sink.endswith("(") else ""
            for index, argument in [(-1, receiver), *enumerate(given)]:
                for origin in taint_of(argument) if argument else ():
                    out.append((*origin, "sink", line, category, argument, index, len(given)))
        for call in CALL.finditer(body):
            if call["name"].split(".")[-1] not in WORDS:
                given = arguments(body[call.end() :])
                for index, argument in enumerate(given):
                    for origin in taint_of(argument):
                        out.append((*origin, "call", line, call["name"].split(".")[-1], argument, index, len(given)))
        if not test and (assigned := _ASSIGN.match(body)):
            if found := taint_of(assigned[2]):
                tainted[assigned[1]] = found
            else:
                tainted.pop(assigned[1], None)
        if once is not None:
            guards = guards[:-1]
        if vb:
            depth += bool(test and not body.strip()) or bool(re.match(r"^\s*Else\b", code, re.I))
        else:
            depth += bare.count("{") - bare.count("}")
    return out


def _closing(rest: str) -> tuple[str, str]:
    """A condition in parentheses, and what follows it."""
    masked, depth = _QUOTED.sub(lambda m: "_" * len(m[0]), rest), 0
    for at, sign in enumerate(masked):
        depth += (sign == "(") - (sign == ")")
        if depth == 0 and sign == ")":
            return rest[1:at], rest[at + 1 :]
    return rest.lstrip("("), ""


def reached(rows: DataFrame, found: DataFrame, seeds: DataFrame, marks: DataFrame) -> DataFrame:
    """What sources and parameters reach in each method: sinks, and arguments of calls."""
    long = found.filter(F.col("parameter") != "").select(*METHOD, F.struct(F.lit("parameter").alias("kind"), F.col("line"), F.col("position").cast("string").alias("source"), "parameter").alias("s"))
    own = seeds.join(found.select(*METHOD, "position", "line"), [*METHOD, "position"]).select(*METHOD, F.struct(F.lit("source").alias("kind"), "line", F.col("category").alias("source"), "parameter").alias("s"))
    starts = long.unionByName(own).groupBy(*METHOD).agg(F.sort_array(F.collect_list("s")).alias("starts"))
    tokens = marks.groupBy(*METHOD).agg(F.sort_array(F.collect_list(F.struct("target", "token", "category"))).alias("marks"))
    bodies = rows.groupBy(*METHOD, "language").agg(F.sort_array(F.collect_list(F.struct("line", "code"))).alias("body"))

    def run(frames):
        columns = [x.split()[0] for x in REACHED.split(", ")]
        for frame in frames:
            out = []
            for path, own_id, language, body, begins, tokens_of in zip(*[frame[c] for c in (*METHOD, "language", "body", "starts", "marks")], strict=True):
                seeds_of, marks_of = {}, {}
                for s in begins if begins is not None else ():
                    seeds_of.setdefault(s["parameter"], []).append((s["kind"], s["line"], s["source"]))
                for m in tokens_of if tokens_of is not None else ():
                    marks_of.setdefault(m["target"], []).append((m["token"], m["category"]))
                out += [(path, own_id, *x) for x in follow([(s["line"], s["code"]) for s in body], seeds_of, marks_of, language == "vb")]
            yield pd.DataFrame(out, columns=columns)

    return bodies.join(starts, METHOD, "left").join(tokens, METHOD, "left").mapInPandas(run, REACHED).distinct()


def slices(files: DataFrame, facts: DataFrame, table: DataFrame, rounds: int = 3) -> DataFrame:
    """Slices of C# and Visual Basic files: within methods, and through calls at most ``rounds`` deep (the bound is the feature).

    A call meets the method of its name and number of parameters, that of its file or else the only one.
    """
    files = files.filter(F.col("language").isin("csharp", "vb"))
    found, rows = parameters(facts), statements(files, facts)
    flows = stored(reached(rows, found, parameter_sources(found, table), operation_rules(rows, facts, table)))
    methods = found.select("path", "method_id", "method", "arity").distinct()
    only = lambda *by: methods.groupBy(*by, F.col("method").alias("sink"), "arity").agg(F.count("*").alias("_n"), F.min(F.struct(*METHOD)).alias("_m")).filter("_n = 1")
    calls = flows.filter("sink_kind = 'call'").join(only("path").select("path", "sink", "arity", F.col("_m").alias("_near")), ["path", "sink", "arity"], "left")
    calls = calls.join(only().select("sink", "arity", F.col("_m").alias("_far")), ["sink", "arity"], "left").withColumn("_m", F.coalesce("_near", "_far")).filter("_m IS NOT NULL")
    calls = calls.select(*METHOD, "source_kind", "source_line", "source", "sink_line", "argument", "argument_index", F.struct("_m.*", F.col("argument_index").cast("string").alias("source")).alias("_to"))
    known = flows.filter("source_kind = 'parameter' AND sink_kind = 'sink'").select(F.struct(*METHOD, "source").alias("_to"), F.col("sink").alias("category")).distinct()
    lifted = calls.filter("source_kind = 'parameter'").select(F.struct(*METHOD, "source").alias("_from"), "_to").distinct()
    lifted, known = stored(lifted), stored(known)
    for _ in range(rounds):
        known = stored(known.unionByName(lifted.join(known, "_to").select(F.col("_from").alias("_to"), "category")).distinct())
    through = calls.filter("source_kind = 'source'").join(known, "_to").withColumn("through", F.col("_to.method_id"))
    direct = flows.filter("source_kind = 'source' AND sink_kind = 'sink'").withColumnRenamed("sink", "category").withColumn("through", F.lit(None).cast("string"))
    columns = [*METHOD, "source_line", F.col("source").alias("source_category"), "sink_line", F.col("category").alias("sink_category"), F.col("argument").alias("sink_argument"), "argument_index", "through"]
    return stored(direct.select(*columns).unionByName(through.select(*columns)).distinct())


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of slices: every end of an edge is a node."""
    end = lambda part: F.concat_ws(":", "path", F.lit(part), F.col(f"{part}_line").cast("string"), F.col(f"{part}_category"))
    node = lambda part: found.select(end(part).alias("id"), F.lit(part.capitalize()).alias("kind"), F.col("path").alias("file_name"), F.col(f"{part}_line").alias("line"), F.col(f"{part}_category").alias("category"))
    return node("source").unionByName(node("sink")).distinct(), found.select(end("source").alias("source_id"), end("sink").alias("target_id")).distinct()
