"""Graphs of facts: building, reachability and slices."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import location, weakness_kind, weakness_number
from factloom.operators.aggregates import first_per_key
from factloom.operators.joins import first_in_order


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder: cuts the lineage of a loop and outlives lost executors."""
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_factloom_graph", None)
    if not base:
        base = spark._factloom_graph = "file://" + tempfile.mkdtemp(prefix="factloom-")
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _merged(tiers: list[list[DataFrame]], level: DataFrame, width: int = 32) -> list[list[DataFrame]]:
    """``tiers`` with one more level; ``width`` tables of a tier become one of the next, so that long walks read few tables."""
    tiers = [list(x) for x in tiers]
    tiers[0].append(level)
    for k, tier in enumerate(tiers):
        if len(tier) < width:
            break
        if k + 1 == len(tiers):
            tiers.append([])
        tiers[k + 1].append(stored(_all(tier)))
        tier.clear()
    return tiers


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def reach(edges: DataFrame, starts: DataFrame, group: str | None = None, back: bool = False) -> DataFrame:
    """G1: (group,) id and depth of all nodes that the starts reach, by a frontier that joins the edges level by level.

    Each level is written once, and once more for 32 levels, 1024 and so on; a level reads the edges and the frontier, not
    the earlier levels' plans. The walk ends when nothing new is found, however long the chains are.
    """
    a, b = ("target_id", "source_id") if back else ("source_id", "target_id")
    on = [group] if group else []
    steps = stored(edges.select(F.col(a).alias("id"), F.col(b).alias("_next")).distinct())
    frontier = stored(starts.select(*on, "id").distinct().withColumn("depth", F.lit(0)))
    tiers, depth = [[frontier]], 0
    while True:
        depth += 1
        seen = _all([x for tier in tiers for x in tier])
        step = frontier.join(steps, "id").select(*on, F.col("_next").alias("id")).distinct()
        frontier = stored(step.join(seen.select(*on, "id"), [*on, "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            return seen
        tiers = _merged(tiers, frontier)


def nearest(reached: DataFrame, most: int = 64, group: str | None = None) -> DataFrame:
    """The first ``most`` nodes by depth and id; the bound is the feature."""
    order = [F.col("depth"), F.col("id")]
    if group is None:
        return reached.orderBy(*order).limit(most)
    return reached.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def entry_tags(edges: DataFrame, entries: DataFrame, most_back: int = 64) -> DataFrame:
    """Node id and the sorted ids of the entries that reach it, or that it reaches within the bound."""
    ahead = reach(edges, entries, group="entry_id")
    behind = nearest(reach(edges, entries, group="entry_id", back=True), most_back, "entry_id")
    return ahead.unionByName(behind).groupBy("id").agg(F.array_sort(F.collect_set("entry_id")).alias("entry_ids"))


def with_external_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (id, external) and an external node for every unknown end of an edge."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    missing = ends.join(nodes, "id", "left_anti").withColumn("external", F.lit(True))
    return nodes.unionByName(missing, allowMissingColumns=True)


def distinct_edges(edges: DataFrame, order: list) -> DataFrame:
    """One edge per source, target, kind and label."""
    return first_per_key(edges, ["source_id", "target_id", "kind", "label"], order)


def slices(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per path (slice_id, node_ids) its first source node, edges among its nodes and distinct packages, sorted."""
    long = paths.select("slice_id", F.posexplode("node_ids").alias("pos", "id"))
    known = long.join(nodes.select("id", "is_source", "purl"), "id")
    heads = known.groupBy("slice_id").agg(
        F.min_by("id", F.when(F.col("is_source"), F.col("pos"))).alias("source_id"), F.array_sort(F.collect_set("purl")).alias("purls"))
    inner = edges.select(F.col("id").alias("edge_id"), "source_id", "target_id")
    inside = inner.join(long.select("slice_id", F.col("id").alias("source_id")), "source_id").join(
        long.select("slice_id", F.col("id").alias("target_id")), ["slice_id", "target_id"], "left_semi")
    lists = inside.groupBy("slice_id").agg(F.array_sort(F.collect_set("edge_id")).alias("edge_ids"))
    return paths.join(heads, "slice_id", "left").join(lists, "slice_id", "left")


def slice_locations(slices_: DataFrame, nodes: DataFrame, edges: DataFrame, source_file: Column | None = None) -> DataFrame:
    """Per slice and package its code locations: from nodes of the package, else edges to it, else the sink's, else the source's."""
    place = ["path", "file_name", "line", "column"]
    wanted = slices_.select("slice_id", F.explode("purls").alias("purl"), "node_ids", "edge_ids", "source_id", "sink_id", "sink_purl")
    by_node = wanted.select("slice_id", "purl", F.explode("node_ids").alias("id")).join(nodes.select("id", "purl", *place), ["id", "purl"]).withColumn("_rank", F.lit(0)).drop("id")
    by_edge = wanted.select("slice_id", "purl", F.explode("edge_ids").alias("id")).join(
        edges.select("id", F.col("target_purl").alias("purl"), *place), ["id", "purl"]).withColumn("_rank", F.lit(0)).drop("id")
    sink = wanted.filter(F.col("sink_purl") == F.col("purl")).select("slice_id", "purl", F.col("sink_id").alias("id")).join(nodes.select("id", *place), "id").withColumn("_rank", F.lit(1)).drop("id")
    source = wanted.select("slice_id", "purl", F.col("source_id").alias("id")).join(nodes.select("id", *place), "id").withColumn("_rank", F.lit(2)).drop("id")
    rows = by_node.unionByName(by_edge).unionByName(sink).unionByName(source).filter(F.col("line") > 0)
    if source_file is not None:
        rows = rows.filter(source_file)
    best = F.min("_rank").over(Window.partitionBy("slice_id", "purl"))
    return rows.withColumn("_best", best).filter("_rank = _best").drop("_rank", "_best").distinct()


def weaknesses(slices_: DataFrame, nodes: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """A weakness candidate per slice."""
    fields = ["is_source", "is_sink", "category", "name", "file_name", "method", "line", "column"]
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in fields if c in nodes.columns])
    out = slices_.join(end("source").drop("source_category"), "source_id", "left").join(end("sink").drop("sink_category"), "sink_id", "left")
    if entries is not None:
        own = entries.select(F.lower("file_name").alias("_file"), F.col("method").alias("_method"), F.col("line").alias("_line"), F.col("id").alias("entry_id"), "route", F.col("ord").alias("_ord"))
        near = (F.col("_method") == F.col("source_method")) | (F.col("_line") <= F.col("source_line"))
        out = first_in_order(out.withColumn("_file", F.lower("source_file_name")), own, ["_file"], near, "slice_id", "_ord", ["entry_id", "route"]).drop("_file")
    else:
        out = out.withColumns({"entry_id": F.lit(None).cast("string"), "route": F.lit(None).cast("string")})
    sink = F.coalesce("sink_is_sink", F.lit(False))
    level = F.when(F.col("entry_id").isNotNull() & sink, "High").when(sink, "Medium").otherwise("Low")
    summary = F.concat(F.coalesce("source_category", F.lit("input")), F.lit(" data reaches "), F.coalesce("sink_category", F.lit("sink")), F.lit(" sink "), F.coalesce("sink_name", "sink_id"), F.lit("."))
    return out.withColumn("kind", weakness_kind(F.col("sink_category"))).withColumns({
        "cwe": weakness_number(F.col("kind")), "confidence": level, "summary": summary,
        "source_location": location(F.col("source_file_name"), F.col("source_line"), F.col("source_column")),
        "sink_location": location(F.col("sink_file_name"), F.col("sink_line"), F.col("sink_column")),
    })
