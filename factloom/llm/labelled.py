"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, hash_unit, materialize


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_column: str, fold: int, text: str = "text") -> tuple[DataFrame, dict[int, int], DataFrame]:
    """(_id, _text, _label) of at most ``per_class`` documents of each class, the classes' sizes, and all labels (_id, _label).

    Only labels of documents in ``docs`` whose crc32(id) mod ``fold`` isn't 0 count. Null labels are none; of several
    labels for a document the largest counts. The sample is the ids with the smallest hashes; it is bounded, and so
    it is broadcast to the documents, which aren't shuffled.
    """
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label).isin(0, 1) & (crc_mod(id_column, fold) != 0))
    known = known.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    # each id once: rows that share an id don't meet in one task
    known = materialize(known.join(docs.select(F.col(id_column).alias("_id")).distinct(), "_id", "left_semi"))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = None
    for value in sorted(sizes):
        part = known.filter(F.col("_label") == value).orderBy(hash_unit("_id", seed=3), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known.limit(0)
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    # repeated ids count once, so the sample stays bounded
    return rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")), sizes, known


def held_out(id_column: str, fold: int) -> Column:
    return crc_mod(id_column, fold) == 0
