"""The filter language against a plain evaluation in Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.plans import dsl

ROWS = [
    {"count": 9, "name": "Alpha", "tags": ["a", "B"], "inner": {"k": "10"}, "note": "1,000"},
    {"count": 10, "name": "beta", "tags": [], "inner": {"k": "x"}, "note": "1d"},
    {"count": 11, "name": None, "tags": ["b"], "inner": None, "note": "NaN"},
]
SCHEMA = "count int, name string, tags array<string>, inner struct<k:string>, note string"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(r["count"], r["name"], r["tags"], None if r["inner"] is None else (r["inner"]["k"],), r["note"]) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).cache()


def run(items, expression):
    found = dsl.query({"items": items}, expression)
    return None if found is None else sorted(r["count"] for r in found.collect())


@pytest.mark.parametrize("expression, expected", [
    ("items", [9, 10, 11]), ("items[", [9, 10, 11]), ("items[count>=10 && count<=11]", [10, 11]), ("ITEMS[COUNT=9]", [9]),
    ("items[name=ALPHA]", [9]), ("items[name!=alpha]", [10]), ("items[name~='ET']", [10]), ("items[name>a]", []),
    ("items[tags=b]", [9, 11]), ("items[tags!=a]", [9, 11]), ("items[inner.k>=9]", [9]), ("items[inner.k=x]", [10]), ("items[missing!=1]", []),
    ("items[inner.missing=1]", []), ("items[note=1000]", [9]), ("items[note>1]", [9]), ("items[note=nan]", [11]), ("items[tags.x=1]", []),
    ("items[count=1e1]", [10]), ("items[count~=1]", [10, 11]), ("items[ && count>9 && ]", [10, 11]),
])
def test_cases(items, expression, expected):
    assert run(items, expression) == expected


def test_absent_collection(items):
    assert run(items, "other[count=1]") is None
    assert dsl.parse("SLICE").collection == "slices" and dsl.parse("Mine").collection == "Mine"


def test_first_operator_in_order_wins():
    assert dsl.parse("x[a=b>=c]").filters == (dsl.Filter(("a=b",), ">=", "c"),)
    assert dsl.parse("x[flag]").filters == (dsl.Filter(("flag",), "=", "true"),)
    assert dsl.parse("x[a='\"q\"']").filters[0].value == "q"


def plain(value, op, literal):
    """The rules of comparison, written out."""
    if value is None:
        return False
    text = str(value)
    if op == "~=":
        return literal.lower() in text.lower()
    a, b = dsl.number(text), dsl.number(literal)
    if a is not None and b is not None:
        if op in ("=", "!="):
            same = a == b or (math.isnan(a) and math.isnan(b))
            return same if op == "=" else not same
        if math.isnan(a) or math.isnan(b):
            return op in (">=", "<=") and math.isnan(a) and math.isnan(b)
        return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return {"=": text.lower() == literal.lower(), "!=": text.lower() != literal.lower()}.get(op, False)


VALUES = [None, "", "a", "A", "10", "10.0", "9", " 9 ", "1,0", "1e1", "NaN", "Infinity", "x10", "-3"]


@settings(max_examples=12, deadline=None)
@given(op=st.sampled_from(dsl.OPERATORS), literal=st.sampled_from([v for v in VALUES if v is not None and v.strip() == v]))
def test_text_values(spark, op, literal):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    got = {r.i for r in dsl.query({"t": df}, f"t[v{op}{literal}]").collect()}
    assert got == {i for i, v in enumerate(VALUES) if plain(v, op, literal)}


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"Items":[{"count":9},{"count":10},{"count":11}], "one": 1}')
    assert [r["count"] for r in dsl.query_documents(spark, str(tmp_path / "d.json"), "items[count>=10 && count<=11]").collect()] == [10, 11]
    assert dsl.query_documents(spark, str(tmp_path / "d.json"), "one[x=1]").count() == 0
