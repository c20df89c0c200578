"""The filter language ``collection[property OP value && ...]`` as Catalyst expressions (Q1-Q17).

An expression is parsed on the driver and bound to a schema; what runs is an ordinary filter, so Parquet pushdown and
column pruning apply to comparisons of plain columns. An expression never fails: what can't be bound matches nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The operators in the order in which they are looked for (Q3).
OPERATORS = ("~=", "!=", ">=", "<=", "=", ">", "<")
#: Other names of collections, in lower case (Q6).
ALIASES = {
    "node": "nodes",
    "nodes": "nodes",
    "edge": "edges",
    "edges": "edges",
    "slice": "slices",
    "slices": "slices",
    "weakness": "weaknessCandidates",
    "weaknesses": "weaknessCandidates",
    "weaknesscandidates": "weaknessCandidates",
    "entrypoint": "entryPoints",
    "entrypoints": "entryPoints",
    "package": "packageReachability",
    "packages": "packageReachability",
    "packagereachability": "packageReachability",
    "dangerous": "dangerousApiReachability",
    "dangerousapis": "dangerousApiReachability",
    "dangerousapireachability": "dangerousApiReachability",
    "summary": "methodSummaries",
    "summaries": "methodSummaries",
    "methodsummaries": "methodSummaries",
    "cryptoasset": "assets",
    "cryptoassets": "assets",
    "assets": "assets",
    "cryptooperation": "operations",
    "cryptooperations": "operations",
    "operations": "operations",
    "cryptomaterial": "materials",
    "cryptomaterials": "materials",
    "materials": "materials",
    "cryptoprotocol": "protocols",
    "cryptoprotocols": "protocols",
    "protocols": "protocols",
    "cryptofinding": "findings",
    "cryptofindings": "findings",
    "findings": "findings",
}
#: Texts that read as a number: digits with thousands separators, a fraction, an exponent (Q10).
NUMBER = r"^\s*[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL = {"nan": math.nan, "infinity": math.inf, "-infinity": -math.inf, "∞": math.inf, "-∞": -math.inf}


@dataclass(frozen=True)
class Filter:
    path: tuple[str, ...]
    operator: str
    value: str


@dataclass(frozen=True)
class Query:
    collection: str
    filters: tuple[Filter, ...]


def parse(expression: str) -> Query:
    """Q1-Q6: the first ``[``, the last ``]``; without both there are no filters."""
    text = expression.strip()
    start, end = text.find("["), text.rfind("]")
    name = (text if start < 0 else text[:start]).strip()
    inside = text[start + 1 : end] if 0 <= start < end else ""
    filters = tuple(_filter(x) for x in map(str.strip, inside.split("&&")) if x)
    return Query(ALIASES.get(name.lower(), name), filters)


def _filter(text: str) -> Filter:
    for operator in OPERATORS:
        at = text.find(operator)
        if at > 0:
            path, value = text[:at].strip(), text[at + len(operator) :]
            return Filter(tuple(path.split(".")), operator, value.strip().strip("\"'"))
    return Filter(tuple(text.split(".")), "=", "true")


def number(text: str) -> float | None:
    """The literal as a number, or None."""
    if text.strip().lower() in SPECIAL:
        return SPECIAL[text.strip().lower()]
    return float(text.replace(",", "")) if re.match(NUMBER, text) else None


def _resolve(fields: T.StructType, name: str) -> T.StructField | None:
    """Q7: the first field whose name matches without regard to case."""
    return next((f for f in fields if f.name.lower() == name.lower()), None)


def bind(df: DataFrame, query: Query) -> Column:
    """The conjunction of the query's filters over the columns of ``df``."""
    out = F.lit(True)
    for one in query.filters:
        out = out & F.coalesce(_bind(df.schema, one), F.lit(False))
    return out


def _bind(schema: T.StructType, one: Filter) -> Column:
    """Q8: each step but the last must be an object (or a text that holds a JSON object); arrays aren't traversed."""
    value: Column | None = None
    kind: T.DataType = schema
    for step, name in enumerate(one.path):
        if isinstance(kind, T.StructType):
            field = _resolve(kind, name.strip())
            if field is None:
                return F.lit(False)
            value = F.col(f"`{field.name}`") if value is None else value.getField(field.name)
            kind = field.dataType
        elif isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(name)), kind.valueType
        elif isinstance(kind, T.StringType) and value is not None:
            rest = "".join(f"['{x.strip()}']" for x in one.path[step:])
            value = F.get_json_object(value, "$" + rest)
            break
        else:
            return F.lit(False)
    if isinstance(kind, T.ArrayType):  # Q14: any element, also for !=; an empty array matches nothing
        return F.exists(value, lambda x: F.coalesce(compare(x, kind.elementType, one.operator, one.value), F.lit(False)))
    return compare(value, kind, one.operator, one.value)


def compare(value: Column, kind: T.DataType, operator: str, literal: str) -> Column:
    """Q10-Q13, Q17: numbers if both sides are, else texts without regard to case; null is missing and never matches."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        value, kind = F.to_json(value), T.StringType()
    text = value.cast("string")
    if operator == "~=":
        return F.contains(F.lower(text), F.lit(literal.lower()))
    as_text = {"=": F.lower(text) == literal.lower(), "!=": F.lower(text) != literal.lower()}.get(operator, F.lit(False) & text.isNotNull())
    wanted = number(literal)
    if wanted is None:
        return as_text
    if isinstance(kind, T.NumericType):
        return _numbers(value.cast("double") if isinstance(kind, (T.FloatType, T.DecimalType)) else value, operator, wanted)
    if not isinstance(kind, T.StringType):
        return as_text
    numeric = F.when(value.rlike(NUMBER), F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double"))
    for name, special in SPECIAL.items():
        numeric = F.when(F.lower(F.trim(value)) == name, F.lit(special)).otherwise(numeric)
    return F.when(numeric.isNotNull(), _numbers(numeric, operator, wanted)).otherwise(as_text)


def _numbers(value: Column, operator: str, wanted: float) -> Column:
    """NaN equals NaN and is neither larger nor smaller than any number."""
    right = F.lit(wanted)
    if operator in ("=", "!="):
        return value == right if operator == "=" else value != right
    found = {">": value > right, "<": value < right, ">=": value >= right, "<=": value <= right}[operator]
    both_nan = F.isnan(value) & F.isnan(right) if operator in (">=", "<=") else F.lit(False)
    return both_nan | (found & ~F.isnan(value) & ~F.isnan(right))


def query(tables: dict[str, DataFrame], expression: str) -> DataFrame | None:
    """Whole rows of the named table that match (Q16); None if there is no such table (Q15)."""
    one = parse(expression)
    name = next((x for x in tables if x.lower() == one.collection.lower()), None)
    return None if name is None else tables[name].filter(bind(tables[name], one))


def query_documents(spark: SparkSession, path: str, expression: str) -> DataFrame:
    """Matching elements of a collection of JSON documents, with ``document`` and ``ord``.

    A collection that is absent or no array gives no rows.
    """
    one = parse(expression)
    docs = spark.read.option("multiLine", True).json(path).withColumn("document", F.input_file_name())
    field = _resolve(docs.schema, one.collection)
    if field is None or not isinstance(field.dataType, T.ArrayType):
        return spark.createDataFrame([], "document string, ord int")
    rows = docs.select("document", F.posexplode(f"`{field.name}`").alias("ord", "_row"))
    rows = rows.select("document", "ord", "_row.*") if isinstance(field.dataType.elementType, T.StructType) else rows.withColumnRenamed("_row", "value")
    return rows.filter(bind(rows, one))
