"""Aggregations and windows over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import evidence_score


def ordered_distinct(value: str, ord_column: str) -> Column:
    """The group's values in order, each once, where it first occurs."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(ord_column, value))), lambda x: x[value]))


def distinct_ignoring_case(rows: DataFrame, key: list[str], value: str, ord_column: str) -> DataFrame:
    """Rows whose value in lower case comes first in its key."""
    lowered = rows.withColumn("_v", F.lower(value))
    return lowered.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_v").orderBy(ord_column))).filter("_n = 1").drop("_n", "_v")


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def merge_first_non_blank(rows: DataFrame, key: list[str], columns: list[str], ord_column: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """Per key and column the first value that isn't blank; flags hold if all do."""
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return rows.groupBy(*key).agg(
        *[F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col(ord_column))).alias(c) for c in columns],
        *[F.bool_and(c).alias(c) for c in flags])


def reachability(contributions: DataFrame) -> DataFrame:
    """A1, A2: per package the distinct ids in order and the kind of the first contribution.

    ``contributions``: purl, ord, kind, id, evidence.
    """
    return contributions.groupBy("purl").agg(
        ordered_distinct("id", "ord").alias("ids"), F.min_by("kind", "ord").alias("kind"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def confidence(facts: DataFrame, evidence: str = "evidence", slices: str = "slice_ids") -> DataFrame:
    """A3: confidence from the best evidence or a slice, and the reason for it."""
    best = F.coalesce(F.array_max(F.transform(evidence, evidence_score)), F.lit(0))
    level = F.when(best >= 3, "High").when((best >= 2) | (F.size(slices) > 0), "Medium").otherwise("Low")
    reason = (
        F.when(F.col("confidence") == "High", "Reachability is supported by direct source or IL call evidence.")
        .when(F.col("confidence") == "Medium", "Reachability is supported by summaries, metadata, or data-flow slices.")
        .otherwise("Reachability is inferred from heuristic or unresolved evidence.")
    )
    return facts.withColumn("confidence", level).withColumn("reason", reason).withColumn(evidence, F.array_sort(F.array_distinct(evidence)))


def counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A row per name with the number of its rows that fulfil a condition."""
    out = None
    for name, (df, condition) in tables.items():
        one = df.agg(F.count_if(condition).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def upsert(rows: DataFrame, key: list[str], first: list[str], any_of: list[str], lists: list[str], ord_column: str) -> DataFrame:
    """One row per key: first values, flags that hold if any does, merged lists."""
    return rows.groupBy(*key).agg(
        *[F.min_by(c, ord_column).alias(c) for c in first], *[F.bool_or(c).alias(c) for c in any_of],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])


def inverted(rows: DataFrame, lists: str, id_column: str) -> DataFrame:
    """For each list element the sorted ids of the rows that have it."""
    return rows.select(F.explode(lists).alias("key"), id_column).groupBy("key").agg(F.array_sort(F.collect_set(id_column)).alias("ids"))


def adjacency(edges: DataFrame, back: bool = False) -> DataFrame:
    """Neighbours by node, or those before it."""
    a, b = ("target_id", "source_id") if back else ("source_id", "target_id")
    return edges.groupBy(F.col(a).alias("id")).agg(F.array_sort(F.collect_set(b)).alias("neighbours"))


def merge_summaries(old: DataFrame, new: DataFrame) -> tuple[DataFrame, bool]:
    """Summaries (method_id, item) of both, and whether ``new`` adds any."""
    added = new.join(old, ["method_id", "item"], "left_anti")
    return old.unionByName(new).distinct(), bool(added.limit(1).count())


def carried(rows: DataFrame, key: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, down the rows of a key."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def surrogate_ids(rows: DataFrame, order: list[str], prefix: str, name: str = "id") -> DataFrame:
    """Prefix and place in a total order, without a one-task window.

    Rows are sorted by ranges of their order; a row's number is its place in its range and the ranges' sizes before it.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    placed = ranged.withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist()
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # a row per partition
    starts, done = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(F.lit(done))
        done += sizes.get(k, 0)
    start = F.get(F.array(*starts), F.col("_p")) if starts else F.lit(0)
    return placed.withColumn(name, F.concat(F.lit(prefix), (start + F.col("_k") + 1).cast("string"))).drop("_p", "_k")


def path_pairs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Each element of a path with the next one."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("next", F.lead(value).over(w)).filter(F.col("next").isNotNull())


def top_per_key(rows: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows per key; Spark applies the limit before the shuffle as well."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= most)


def slice_keys(slices: DataFrame) -> DataFrame:
    """A slice's key; null parts are empty."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return slices.select(F.concat(part("source_category"), F.lit("->"), part("sink_category"), F.lit(":"), part("sink_argument")).alias("key")).distinct()


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, key): keys that were added or removed."""
    return new.subtract(old).select(F.lit("added").alias("change"), "key").unionByName(old.subtract(new).select(F.lit("removed").alias("change"), "key"))


def merge_unique(first: str, second: str) -> Column:
    """The second list's values that aren't blank, appended if they are new."""
    return F.array_distinct(F.concat(F.col(first), F.filter(second, lambda x: F.trim(x) != "")))


def guards(condition_lists: str, either: bool) -> Column:
    """U4: keys that all parts guard (OR), or that any part does (AND)."""
    lists = F.col(condition_lists)
    merge = F.array_intersect if either else F.array_union
    return F.aggregate(F.slice(lists, F.lit(2), F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)), lambda a, x: F.array_sort(merge(a, x)))
