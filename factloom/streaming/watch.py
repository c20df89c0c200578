"""An extension: facts of a folder's new files, as a stream.

Each micro-batch extracts facts from the files that arrived and appends them to a table; files are told apart by path,
and the checkpoint makes a restart continue where the last batch ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import frontends
from factloom.sources import files


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and what has arrived since the last run, then stop."""
    arrived = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    texts = arrived.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def add(batch: DataFrame, _: int) -> None:
        frontends.extract(files.scan(batch)).write.mode("append").parquet(out)

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per kind and window; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).count()
