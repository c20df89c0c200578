"""WARC archives: revisit resolution, deduplicated writing and reading.

Only headers (digest, id, URL, size) are shuffled to find the record that each group of equal payloads keeps.
Records whose digest a Bloom filter of the repeated digests doesn't have stay where they are, as responses; the others
meet their verdict in one join by digest, in which digests of many records stay in place, too.
Archives are written by Spark's own text writer (CR LF CR LF ends a record, as the format asks), thus to any
store that Spark can write, and read by ``binaryFile`` and a parser that follows Content-Length.

Defined cases: a null payload is the empty one. Equal rows (same id, same payload) are one capture; each of them
is a response if its id is the kept one. A null id is smaller than all others. A null URL gives no
WARC-Target-URI. CR and LF in a URL are percent-encoded, ids wholly; an empty id is read back as null. An empty table gives
no archive records. Files are read whole: ``per_file`` records of an archive should compress to less than 2 GB. Columns
other than id, URL and payload, of any name, play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import join_hot, materialize, shared_dir
from factloom.llm.url_filter import build_filter

ID_PREFIX = "urn:x-record:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Repeated digests at most for which a Bloom filter (10 bits each) spares single records the shuffle.
MOST_FILTERED = 10_000_000
READ_SCHEMA = (
    "record_id string, target_uri string, record_type string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest in upper-case base32, from built-in functions: 20 bits are 5 hex digits and 4 base32 digits.

    A lambda's variable holds the digest, as filters would hash the payload again for each time that it is named.
    """

    def base32(digest: Column) -> Column:
        parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
        return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    return F.get(F.transform(F.array(F.sha1(payload)), base32), F.lit(0))


def capture_headers(pages: DataFrame, id_column: str, url: str, payload: str) -> DataFrame:
    """``pages`` as captures: _id, _url, _payload, _digest, _bytes."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(
        F.col(id_column).alias("_id"), F.col(url).alias("_url"), body.alias("_payload"),
        F.octet_length(body).cast("long").alias("_bytes"), base32_sha1(body).alias("_digest"),
    )


def resolve_revisits(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add _type and, for revisits, _refers_id and _refers_url: the original response of the same payload.

    Of the captures of one digest and at least ``min_bytes`` bytes that with the largest _id is the response.
    """
    large = F.col("_bytes") >= min_bytes
    first = materialize(
        captures.filter(large).groupBy("_digest").agg(
            F.max("_id").alias("_original"), F.max_by("_url", "_id").alias("_original_url"), F.count("*").alias("_n"))
        .filter("_n > 1").withColumnRenamed("_digest", "_key")
    )
    n = first.count()
    again = large
    if n <= MOST_FILTERED:
        # the filter names its key many times; here it is a lambda's variable, made once
        again = large & F.exists(F.array("_digest"), build_filter(first.select(F.col("_key").alias("key")), n, 0.01, 1).has)
    single = [F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema if f.name in ("_original", "_original_url")]
    joined = join_hot(captures.filter(again).withColumn("_key", F.col("_digest")), first, "_key", "_n").drop("_key")
    joined = captures.filter(~again).select("*", *single).unionByName(joined)
    revisit = F.col("_original").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_original"))
    return joined.select(
        "_id", "_url", "_payload", "_bytes", "_digest",
        F.when(revisit, "revisit").otherwise("response").alias("_type"),
        F.when(revisit, F.col("_original")).alias("_refers_id"),
        F.when(revisit, F.col("_original_url")).alias("_refers_url"),
    )


def _uri(name: str, value: Column) -> Column:
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit(CRLF)), F.lit(""))


def _record_uri(value: Column) -> Column:
    """The id, percent-encoded; a null id has no text at all."""
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.url_encode(value.cast("string")), F.lit("")), F.lit(">"))


def warc_record(date: str) -> Column:
    """The text of a record: fresh headers and an HTTP block, which has the payload in responses only."""
    revisit = F.col("_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("_type"), F.lit(f"{CRLF}WARC-Record-ID: "), _record_uri(F.col("_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"), _uri("WARC-Target-URI", F.col("_url")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"), F.lit(CRLF),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "), _record_uri(F.col("_refers_id")), F.lit(CRLF),
            _uri("WARC-Refers-To-Target-URI", F.col("_refers_url")),
        )).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        block_bytes.cast("string"), F.lit(CRLF + CRLF), http,
        F.when(revisit, F.lit("")).otherwise(F.col("_payload")),
    )


def write_archives(resolved: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", per_file: int = 2000) -> None:
    """Write gzip-compressed archives of at most ``per_file`` records each below ``path``."""
    (
        resolved.select(warc_record(date).alias("value")).write
        .option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    )


def parse_archive(stream) -> Iterator[dict]:
    """The records of a decompressed archive, by their Content-Length; a record that is cut off raises ValueError."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record must begin here")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the archive ends in a header")
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        if len(block) < size:
            raise ValueError("the archive ends in a record")
        head, _, body = block.partition(b"\r\n\r\n")
        revisit = headers["warc-type"] == "revisit"
        if revisit:
            lengths = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            digest, count, body = headers["warc-payload-digest"].removeprefix("sha1:"), int(lengths[0]), None
        else:
            digest, count = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
            if headers["warc-payload-digest"] != f"sha1:{digest}":
                raise ValueError("a payload differs from its digest")
        yield {
            "record_id": _own_id(headers.get("warc-record-id")), "target_uri": headers.get("warc-target-uri"),
            "record_type": headers["warc-type"], "refers_to": _own_id(headers.get("warc-refers-to")),
            "payload_digest": digest, "payload_bytes": count, "payload": body,
        }


def _own_id(uri: str | None) -> str | None:
    return None if uri is None else unquote_plus(uri.strip("<>").removeprefix(ID_PREFIX)) or None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``, with digest and size recomputed from the payloads."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for record in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    if not with_payload:
                        record["payload"] = None
                    rows.append(record)
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, READ_SCHEMA)


def deduplicate(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Resolve and write ``pages`` below ``path``."""
    write_archives(resolve_revisits(capture_headers(pages, id_column, url, payload), min_bytes), path)


def op1(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages``, read them again and return a row per page."""
    path = shared_dir(spark)
    deduplicate(pages, path)
    return read_archives(spark, path, with_payload=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
