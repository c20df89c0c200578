"""A training corpus from raw documents, in five stages; each works on all that the one before it kept.

Rows are decided one by one. A row is told apart by a number that the stage gives it, never by its id, so that null and
repeated ids are no special case: rejection, near-duplicates and copies concern the row. Columns of any name stay as they
are, but for the last stage, which returns its result's. An empty table gives an empty one.

Defined cases, by stage. A null text is the empty one throughout, and texts are read whole, however long they are.
toxicity and quality classifier: equal texts get one verdict; labels of null ids don't count; without labels of both
classes the score is the smoothed share of label 1, so that all rows stay or all go. near-duplicates: of a group the row
with the smallest id stays, of equal ids that with the smallest row number, a null id being the last; rows without words
are linked with nothing and stay. mixing: a null source is a source of its own; rows without words are taken never;
equal rows are drawn each. bpe: each row is encoded, without words to no token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, mixing, neardup, pairwise_quality, toxicity
from factloom.llm.common import free_name, materialize, table
from factloom.llm.queries import tokenizer_path

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranking doesn't reject."""
    return pairwise_quality.keep_good(docs, pairwise_quality.train(docs, table(spark, sf_dir, "labels")))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents as a table with a column that numbers the rows, and its name: ids may be null or repeated."""
    row = free_name(docs.columns, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id())), row


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, null being the last."""
    rows, row = numbered(docs)
    found = neardup.find(rows, size=SHINGLE, percent=80, row=row)
    return rows.join(found.filter("kept").select(row), row, "left_semi").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it. The draw is by id and text, so that the rows' order doesn't matter."""
    rows, row = numbered(docs)
    draw = free_name(rows.columns, "_draw")
    copies = mixing.mix(rows.withColumn(draw, F.xxhash64("doc_id", "text")), id_column=draw, row=row).filter("copies > 0")
    taken = copies.select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(row)
    return rows.join(taken, row).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.digest_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", clean),
    ("quality classifier", good),
    ("near-duplicates", distinct),
    ("mixing", mixed),
    ("bpe", encoded),
]
#: No stage but the mix can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
