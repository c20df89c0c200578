"""Declarations, imports and calls of F#, R and C/C++ files (E8-E10, W6), from built-in functions.

Every line is one row. What a line declares comes from one regular expression; what holds at a line (namespace, class,
function) is the last declaration at or before it, a window per file. A deeper ``let`` of F# is no declaration: that is so
where its indent exceeds the least indent of the declarations before it since the last module or type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import lines

FACTS = "path string, language string, fact string, namespace string, class string, name string, detail string, line int, column int"
#: Declarations and calls of the line languages.
FSHARP_MODULE = r"^\s*(?:namespace|module)\s+([\w\.]+)"
FSHARP_OPEN = r"^\s*open\s+(?:type\s+)?([\w\.]+)"
FSHARP_TYPE = r"^\s*type\s+(\w+)"
FSHARP_FUNCTION = r"^\s*(?:let|member)\s+(?:rec\s+)?(?:\w+\.)?(\w+)"
FSHARP_CALL = r"\b([A-Za-z_][\w\.]*)\s+(?:\(|\"|[A-Za-z0-9_])"
R_FUNCTION = r"^\s*([A-Za-z_][\w\.]*)\s*(?:<-|=)\s*function\s*\("
R_LIBRARY = r"\b(?:library|require)\s*\(\s*['\" ]?([A-Za-z0-9_.]+)"
R_CALL = r"([A-Za-z_][\w\.:]*)\s*\("
CPP_INCLUDE = r"^\s*#\s*include\s*[<\" ]([^>\" ]+)"
CPP_FUNCTION = r"^\s*(?:[\w:<>,~*&]+\s+)+(?:([A-Za-z_][\w]*)::)?([A-Za-z_~][\w~]*)\s*\([^;]*\)\s*(?:const\s*)?(?:\{|$)"
CPP_CALL = r"([A-Za-z_][\w:]*)(?:\s*<[^>]+>)?\s*\("
#: Words that are no names, in any case.
KEYWORDS = ("if", "then", "else", "elif", "for", "while", "do", "match", "with", "try", "catch", "finally", "let", "rec", "and", "fun", "function", "in", "open", "module", "type", "namespace",
            "return", "static", "new", "null", "nullptr", "sizeof", "switch", "case", "library", "require")
#: Names outside any declaration.
SPACES = {"fsharp": "Global", "r": "R", "cpp": "C++"}
MEMBERS = {"r": "script", "cpp": "translation_unit"}
LANGUAGES = ("fsharp", "r", "cpp")


def by_language(**values: Column) -> Column:
    out = F.lit(None)
    for language, value in values.items():
        out = F.when(F.col("language") == language, value).otherwise(out)
    return out


def group(pattern: str, number: int = 1, code: str = "code") -> Column:
    """A group of the first match, null if there is none."""
    found = F.regexp_extract(code, f"(?U){pattern}", number)
    return F.when(found != "", found)


def occurrences(code: Column, pattern: str) -> Column:
    """name (the pattern's only group) and at (from 0) of all matches: each is found with what lies before it."""
    part = lambda k: F.regexp_extract_all(code, F.lit(f"(?Us)(.*?)(?:{pattern})"), F.lit(k))
    ends = lambda i: F.aggregate(F.slice(F.transform(part(0), F.length), F.lit(1), i), F.lit(0), lambda a, n: a + n)
    before = part(1)
    return F.transform(part(2), lambda name, i: F.struct(name.alias("name"), (ends(i) + F.length(F.get(before, i))).alias("at")))


def is_word(name: Column) -> Column:
    return F.lower(name).isin(*KEYWORDS)


def place_of(name: Column) -> Column:
    """The 1-based column of a name in its line."""
    return F.greatest(F.lit(1), F.instr("code", name)).cast("int")


def with_scope(rows: DataFrame) -> DataFrame:
    """Add what each line declares (module, opened, typed, declared) and what holds there: namespace, class and member."""
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    function = group(FSHARP_FUNCTION)
    out = rows.withColumns({
        "module": by_language(fsharp=group(FSHARP_MODULE)),
        "opened": by_language(fsharp=group(FSHARP_OPEN), cpp=group(CPP_INCLUDE)),
        "typed": by_language(fsharp=group(FSHARP_TYPE), cpp=group(CPP_FUNCTION, 1)),
        "_name": by_language(fsharp=F.when(~is_word(function), function), r=group(R_FUNCTION), cpp=group(CPP_FUNCTION, 2)),
        "_indent": F.length(F.regexp_extract("code", r"(?U)^(\s*)", 1)),
    })
    sharp = F.col("language") == "fsharp"
    resets = F.when(sharp & (F.col("module").isNotNull() | F.col("typed").isNotNull()), 1).otherwise(0)
    in_file = Window.partitionBy("path").orderBy("line")
    out = out.withColumn("_part", F.sum(resets).over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("path", "_part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(F.when(F.col("_name").isNotNull(), F.col("_indent"))).over(earlier)
    out = out.withColumn("_inner", sharp & F.col("_name").isNotNull() & F.coalesce(F.col("_indent") > least, F.lit(False)))
    out = out.withColumn("declared", F.when(~F.col("_inner"), F.col("_name")))
    up_to = in_file.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(up_to)
    class_name = F.coalesce(F.element_at(F.split("module", r"\."), -1), F.col("typed"))
    return out.withColumns({
        "namespace": F.coalesce(last(F.col("module")), by_language(**{k: F.lit(v) for k, v in SPACES.items()})),
        "class": by_language(fsharp=F.coalesce(last(class_name), F.lit("Module")), r=stem, cpp=F.coalesce(last(F.col("typed")), stem)),
        "member": F.coalesce(last(F.col("declared")), by_language(**{k: F.lit(v) for k, v in MEMBERS.items()})),
        "_stem": stem,
    })


def extract(files: DataFrame) -> DataFrame:
    """Facts of the F#, R and C/C++ files of ``files`` (path, language, text)."""
    rows = lines(files.filter(F.col("language").isin(*LANGUAGES)).select("path", "language", "text"))
    scoped = with_scope(rows)
    none = F.lit(None).cast("string")
    fact = lambda df, kind, name, detail, column, owner="class": df.select(
        "path", "language", F.lit(kind).alias("fact"), "namespace", F.col(owner).alias("class"), name.alias("name"), detail.alias("detail"), F.col("line").cast("int").alias("line"), column.cast("int").alias("column"))
    imports = scoped.withColumn("_import", F.coalesce("module", "opened")).filter("_import is not null")
    at = F.when(F.col("language") == "cpp", F.lit(1)).otherwise(place_of(F.col("_import")))
    libraries = scoped.filter("language = 'r'").withColumn("_x", F.explode(occurrences(F.col("code"), R_LIBRARY)))
    # a file's own scope counts as a method where calls may stand outside functions
    outer = by_language(**{k: F.lit(v) for k, v in MEMBERS.items()})
    scripts = scoped.filter((F.col("line") == 1) & outer.isNotNull())
    methods = scoped.filter("declared is not null")

    brace = F.instr("code", "{")
    after = F.when(brace > 0, brace)  # a declaration without a brace isn't searched for calls
    offset = by_language(
        fsharp=F.when(F.col("module").isNull() & F.col("opened").isNull() & F.col("typed").isNull() & ~F.col("_inner") & F.col("member").isNotNull(), F.lit(0)),
        r=F.lit(0), cpp=F.when(F.col("declared").isNotNull(), after).otherwise(F.lit(0)))
    searched = scoped.withColumn("_offset", offset.cast("int")).filter("_offset is not null").withColumn("_body", F.expr("substring(code, _offset + 1)"))
    found = by_language(**{k: occurrences(F.col("_body"), p) for k, p in (("fsharp", FSHARP_CALL), ("r", R_CALL), ("cpp", CPP_CALL))})
    calls = searched.withColumn("_x", F.explode(found))
    callee = F.when(F.col("language") == "fsharp", F.element_at(F.split("_x.name", r"\."), -1)).otherwise(F.col("_x.name"))
    calls = calls.withColumn("_callee", callee).filter(~is_word(F.col("_callee")))
    parts = [
        fact(imports, "dependency", F.col("_import"), none, at),
        fact(libraries, "dependency", F.col("_x.name"), none, F.col("_x.at") + 1),
        fact(scripts, "method", outer, none, F.lit(1), "_stem"),
        fact(methods, "method", F.col("declared"), none, place_of(F.col("declared"))),
        fact(calls, "call", F.col("_callee"), F.col("member"), F.col("_x.at") + F.col("_offset") + 1),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
