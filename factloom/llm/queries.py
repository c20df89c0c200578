"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, bpe, labelled, language_id, mixing, neardup, pairwise_quality, quality_rules, toxicity, url_filter, warc
from factloom.llm.common import table

#: Where the public tokenizers' files are; a parameter of the operators.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a public tokenizer's file, which is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1(spark, table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((strpos('0123456789abcdef', h[5 * (i // 4) + 1]) - 1) * 65536 + (strpos('0123456789abcdef', h[5 * (i // 4) + 2]) - 1) * 4096
      + (strpos('0123456789abcdef', h[5 * (i // 4) + 3]) - 1) * 256 + (strpos('0123456789abcdef', h[5 * (i // 4) + 4]) - 1) * 16
      + (strpos('0123456789abcdef', h[5 * (i // 4) + 5]) - 1)) >> (15 - 5 * (i % 4))::INT) % 32, 1)), 'string_agg', '') AS payload_digest
  FROM p
), o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM original THEN NULL ELSE original END AS refers_to
FROM o
"""


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT row_number() OVER () AS n, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
m AS (SELECT n, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS v
  FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM q LEFT JOIN m USING (n)
"""


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~language_id.held_out())
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", labelled.held_out("doc_id", 5).alias("held_out"), "score", "predicted")


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pairwise_quality.train(docs, table(spark, sf_dir, "labels"))
    return pairwise_quality.score(docs, model).select("doc_id", labelled.held_out("doc_id", 5).alias("held_out"), "score", "predicted")


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents"), size=2, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisits": _op1,
        "op2_bloom_cascade": _op2,
        "op3_word_backoff": _op3,
        "op4_projection_forest": _op4,
        "op5_bpe_transducer": _op5,
        "op6_nb_ngrams": _op6,
        "op7_host_rules": _op7,
        "op8_bradley_terry": _op8,
        "op9_entropy_balancing": _op9,
        "op10_chosen_path": _op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_revisits": OP1_SQL,
        "op2_bloom_cascade": OP2_SQL,
    }
