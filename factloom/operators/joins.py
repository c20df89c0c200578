"""Joins that link facts (J1-J28), as equi-joins, windows and bounded broadcasts.

Sides that grow with the data are never broadcast by hint: Catalyst and AQE choose by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich_edges(edges: DataFrame, nodes: DataFrame, value: str, fallback: Column | None = None) -> DataFrame:
    """source_<value> and target_<value> of the edges' end nodes, the target with a fallback."""
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col(value).alias(f"{side}_{value}"))
    out = edges.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    return out if fallback is None else out.withColumn(f"target_{value}", F.coalesce(f"target_{value}", fallback))


def remap(df: DataFrame, columns: list[str], mapping: DataFrame) -> DataFrame:
    """Replace ids that ``mapping`` (old, new; one row per old) has."""
    for c in columns:
        df = df.join(mapping.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left")
        df = df.withColumn(c, F.coalesce("_new", c)).drop("_new")
    return df


def unique_candidate(left: DataFrame, right: DataFrame, key: list[str], tiers: list[Column], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, tier): the only right row that fulfils a tier's condition, in the first tier with just one.

    Rows meet on ``key`` once; each tier is a count over the pairs.
    """
    pairs = left.join(right, key)
    per_left = Window.partitionBy(left_id)
    for i, condition in enumerate(tiers):
        pairs = pairs.withColumn(f"_c{i}", F.count_if(condition).over(per_left)).withColumn(f"_t{i}", condition)
    tier = F.lit(None).cast("int")
    for i in reversed(range(len(tiers))):
        tier = F.when(F.col(f"_c{i}") == 1, F.lit(i)).otherwise(tier)
    chosen = pairs.withColumn("tier", tier)
    fits = F.lit(False)
    for i in range(len(tiers)):
        fits = fits | ((F.col("tier") == i) & F.col(f"_t{i}"))
    return chosen.filter(fits).select(left_id, right_id, "tier")


def lookup_first(rows: DataFrame, key: str, table: DataFrame, ord_column: str) -> DataFrame:
    """Each row with the first entry of its key."""
    first = table.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(ord_column))).filter("_n = 1").drop("_n")
    return rows.join(first, key, "left")


def first_in_order(left: DataFrame, right: DataFrame, key: list[str], condition: Column, left_id: str, order: str, take: list[str]) -> DataFrame:
    """For each left row the first right row, in order, of the same key that fulfils a condition.

    The aggregate keeps one row per left row, map-side first; nothing is sorted.
    """
    best = left.join(right, key).filter(condition).groupBy(left_id).agg(F.min_by(F.struct(*take), order).alias("_b"))
    return left.join(best, left_id, "left").select(*left.columns, *[F.col(f"_b.{c}").alias(c) for c in take])


def members(rows: DataFrame, groups: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Each row with the sorted list of a group's values."""
    lists = groups.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{groups.schema[value].dataType.simpleString()}>")))


def among(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is a key."""
    return rows.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def both_ends_among(edges: DataFrame, nodes: DataFrame, group: str | None = None) -> DataFrame:
    """Edges with both ends among the nodes (of one group, if given)."""
    on = [group] if group else []
    side = lambda c: nodes.select(*on, F.col("id").alias(c)).distinct()
    out = edges.join(side("source_id"), "source_id") if group else edges.join(side("source_id"), "source_id", "left_semi")
    return out.join(side("target_id"), [*on, "target_id"], "left_semi")


def linked_by_any(left: DataFrame, right: DataFrame, keys: list[list[str]], left_id: str, right_id: str) -> DataFrame:
    """Distinct pairs that agree on at least one of several keys."""
    out = None
    for key in keys:
        pairs = left.select(left_id, *key).join(right.select(right_id, *key), key).select(left_id, right_id)
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def containing(left: DataFrame, right: DataFrame, key: list[str], part: Column, texts: list[str]) -> DataFrame:
    """Pairs of one key where a text of the right row holds the left row's part, in any case."""
    fits = F.lit(False)
    for t in texts:
        fits = fits | F.contains(F.lower(F.coalesce(F.col(t), F.lit(""))), F.lower(part))
    return left.join(right, key).filter((part != "") & fits)


def band(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, width: int = 1) -> DataFrame:
    """Pairs of one key with |a - b| <= width; rows meet on buckets of that width, so long groups don't explode."""
    size = max(1, width)
    left = left.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(a) / size) + i for i in (-1, 0, 1)])))
    right = right.withColumn("_bucket", F.floor(F.col(b) / size))
    return left.join(right, [*key, "_bucket"]).filter(F.abs(F.col(a) - F.col(b)) <= width).drop("_bucket")


def longest_prefix(rows: DataFrame, name: str, prefixes: DataFrame, prefix: str, separator: str = ".", row_id: str = "id") -> DataFrame:
    """Each row with the longest entry that is the name or begins it up to a separator.

    All starts of a name at separators meet the table in an equi-join.
    """
    parts = F.split(F.col(name), F.lit("\\Q" + separator + "\\E"), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    found = (
        rows.select(row_id, F.explode(starts).alias(prefix)).join(prefixes, prefix)
        .groupBy(row_id).agg(F.max_by(F.struct(*prefixes.columns), F.length(prefix)).alias("_b"))
    )
    return rows.join(found, row_id, "left").select(*rows.columns, *[F.col(f"_b.{c}").alias(c) for c in prefixes.columns])


def cascade(rows: DataFrame, row_id: str, candidates: list[Column], table: DataFrame, key: str, value: str) -> DataFrame:
    """The value of the first candidate key that the table has, and the candidate's rank."""
    ranked = F.posexplode(F.array(*[c.cast("string") for c in candidates])).alias("rank", key)
    found = rows.select(row_id, ranked).join(table.select(F.col(key).cast("string").alias(key), value), key).groupBy(row_id).agg(
        F.min(F.struct("rank", value)).alias("_b"))
    return rows.join(found, row_id, "left").select(*rows.columns, F.col("_b.rank").alias("rank"), F.col(f"_b.{value}").alias(value))


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, take: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the latest right row of its key at or before it (before it, if strict).

    Both sides are stacked and one window per key carries the last right row along, so no pair is ever formed.
    """
    fields = [f.name for f in left.schema]
    none = lambda names, schema: [F.lit(None).cast(schema[n].dataType).alias(n) for n in names]
    stacked = left.select(*fields, F.lit(0 if strict else 1).alias("_s"), F.lit(True).alias("_l"), F.lit(None).cast(right.select(F.struct(*take).alias("x")).schema["x"].dataType).alias("_r")).unionByName(
        right.select(*key, F.col(at), *none([f for f in fields if f not in (*key, at)], left.schema), F.lit(1 if strict else 0).alias("_s"), F.lit(False).alias("_l"), F.struct(*take).alias("_r")))
    w = Window.partitionBy(*key).orderBy(F.col(at), "_s").rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_l")
    return carried.select(*fields, *[F.col(f"_r.{c}").alias(f"prior_{c}") for c in take])


def smallest_interval(points: DataFrame, intervals: DataFrame, key: list[str], at: Column, start: str, end: str, point_id: str, take: str) -> DataFrame:
    """Each point with the shortest interval of its key that holds it (start <= at < end)."""
    fits = (at >= F.col(start)) & (at < F.col(end))
    joined = points.join(intervals, key) if key else points.join(F.broadcast(intervals), fits)
    found = joined.filter(fits).groupBy(point_id).agg(F.min_by(take, F.struct((F.col(end) - F.col(start)).alias("w"), F.col(take))).alias(take))
    return points.join(found, point_id, "left")


def without_match(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows of which no other has the key."""
    return rows.join(others.select(*key).distinct(), key, "left_anti")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node; empty for a sound graph."""
    side = lambda c: edges.join(nodes.select(F.col("id").alias(c)), c, "left_anti")
    return side("source_id").unionByName(side("target_id").select(edges.columns)).distinct()


def dispatch(calls: DataFrame, types: DataFrame, methods: DataFrame, instantiated: DataFrame, most: int = 16) -> DataFrame:
    """Virtual calls to the methods of instantiated types below the called type, at most ``most`` per call.

    ``calls``: call_id, type, name, arity; ``types``: type, ancestor (closed, a type is its own ancestor); ``methods``:
    method_id, type, name, arity. The limit is the feature; the smallest ids stay.
    """
    below = types.join(instantiated.select("type").distinct(), "type", "left_semi")
    targets = methods.join(below, "type").select(F.col("ancestor").alias("type"), "name", "arity", "method_id")
    found = calls.join(targets, ["type", "name", "arity"]).select("call_id", "method_id").distinct()
    n = F.row_number().over(Window.partitionBy("call_id").orderBy("method_id"))
    return found.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def owner_of_generated(generated: DataFrame, methods: DataFrame) -> DataFrame:
    """A compiler-generated state type ``Outer/<Name>d__3`` with the method ``Outer.Name``, else by name alone."""
    outer, name = F.regexp_extract("type", r"^(.*)[/+]<", 1), F.regexp_extract("type", r"<([^>]+)>", 1)
    rows = generated.withColumns({"_outer": outer, "_name": name})
    exact = methods.select(F.col("type").alias("_outer"), F.col("name").alias("_name"), F.col("method_id").alias("_exact"))
    by_name = methods.groupBy(F.col("name").alias("_name")).agg(F.min("method_id").alias("_any"), F.count("*").alias("_c")).filter("_c = 1").drop("_c")
    out = rows.join(exact, ["_outer", "_name"], "left").join(by_name, "_name", "left")
    return out.withColumn("owner", F.coalesce("_exact", "_any")).select(*generated.columns, "owner")


def with_summary(calls: DataFrame, summaries: DataFrame) -> DataFrame:
    """A call with its callee's summary, or that of the callee's original definition."""
    by = lambda c, n: summaries.select(F.col("method_id").alias(c), F.col("summary").alias(n))
    out = calls.join(by("callee_id", "_a"), "callee_id", "left").join(by("original_id", "_b"), "original_id", "left")
    return out.withColumn("summary", F.coalesce("_a", "_b")).drop("_a", "_b")
