"""Helpers that the operators of this subpackage share: shared tables, skew-safe joins, bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds at least one of so many rows; there can be no more hot keys than that.
HOT_SHARE = 1000
#: Bytes that separate words in the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (a local session, as in tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_factloom_dir", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="factloom-")
            spark._factloom_dir = base
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage and survives lost executors, as the files are not on an executor's disk.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null value counts as the empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % modulus


def hash_unit(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """Join each row of ``left`` with the only row of its ``key`` in ``right``; no key's rows meet in one task.

    ``right`` should be materialized; its column ``count`` says how many rows of ``left`` have the key. Keys with
    a HOT_SHARE-th of all rows or more, at most HOT_SHARE of them, are broadcast and leave their rows where
    they are. The other keys are joined by a shuffle, in which none is large. A null key matches nothing and isn't
    shuffled.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_SHARE >= F.lit(total)
    hot, rest = right.filter(is_hot).drop(count), right.filter(~is_hot).drop(count)
    keyed = left.filter(F.col(key).isNotNull())
    parts = [
        keyed.join(F.broadcast(hot), key, "inner"),
        keyed.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how),
    ]
    if how == "left":
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in hot.schema if f.name != key]
        parts.append(left.filter(F.col(key).isNull()).select("*", *missing))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name in any case."""
    lowered = {x.lower() for x in taken}
    while wanted.lower() in lowered:
        wanted = "_" + wanted
    return wanted


class TwoAgeCache(dict):
    """A dict for ``map``: keys that are missing are made by ``make``; at most two ages of ``limit`` keys stay."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value




def global_rank(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``, the 0-based place of each row in the order of ``keys``, without a one-task window.

    Rows are sorted by range; a partition's offset is the number of rows in those before it.
    """
    part, place = free_name(df.columns, "_part"), free_name(df.columns, "_place")
    ordered = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    counts = {r[0]: r[1] for r in ordered.groupBy(part).count().collect()}  # a row per partition
    offsets, done = [], 0
    for k in range(max(counts, default=-1) + 1):
        offsets.append(F.lit(done))
        done += counts.get(k, 0)
    start = F.get(F.array(*offsets), F.col(part)) if offsets else F.lit(0)
    return ordered.withColumn(name, start + F.col(place)).drop(part, place)
