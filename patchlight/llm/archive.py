"""A content-addressed WARC archive: payloads stored once by strong digest, exact record headers beside them.

``payloads`` has one row per distinct payload (``address``, its SHA-256, and ``payload``, compressed); ``records`` has one
row per record with the header block as the record would carry it. The record is what a join of the two gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import parted
from .storage import new_path, saved

#: Shorter payloads are never revisits.
LEAST_REVISIT_BYTES = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header_block(page_id: Column, url: Column, kind: Column, refers_to: Column, sha1: Column, size: Column, date: str) -> Column:
    """The bytes of a record's header, up to and with the empty line. Line ends in a url are percent-encoded."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise("")

    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Profile", F.when(kind == "revisit", PROFILE)),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("WARC-Payload-Length", size),
        F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}"),
        line("Content-Length", F.when(kind == "revisit", F.lit(0)).otherwise(size)),
        F.lit(CRLF),
    ).cast("binary")


def _packed(payloads: DataFrame, payload: str) -> DataFrame:
    """The payload column compressed, so that it moves and is stored in few bytes."""
    at = payloads.columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [zstd.compress(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(held, pa.binary()), *batch.columns[at + 1 :]], batch.schema.names)

    return payloads.mapInArrow(run, payloads.schema)


def write_archive(pages: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``) under ``path``; ``date`` is when they were fetched.

    Of records with equal payloads of at least 1000 bytes, that with the largest page_id is the response and the
    others revisit it. A null html is an empty payload. Rows that repeat the largest page_id are responses too; where
    all page_ids of a payload are null, so is the response's. Only digests and ids are grouped. Which payloads are stored is told by a
    filter of fixed size, so that others are neither compressed nor moved (but for the few that it lets pass, which a join then drops); a
    stored one moves once, compressed and spread by page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"address": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    narrow = saved(rows.select("page_id", "url", "address", "sha1", "size"), "warc-rows")
    chosen = saved(narrow.groupBy("address").agg(F.max("page_id").alias("response")), "warc-chosen")
    records = narrow.join(chosen, "address")
    revisits = (F.col("size") >= LEAST_REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("response"))
    records = records.withColumn("kind", F.when(revisits, "revisit").otherwise("response"))
    header = header_block(F.col("page_id"), F.col("url"), F.col("kind"), F.when(revisits, F.col("response")), F.col("sha1"), F.col("size"), date)
    records.select(header.alias("header"), "address").write.parquet(f"{path}/records")
    at = F.coalesce(F.col("page_id"), F.lit(-1))
    kept = chosen.select(F.coalesce("response", F.lit(-1)).alias("at"), "address")
    key = F.xxhash64("at", "address").alias("key")
    _, likely = parted(rows.select(at.alias("at"), "address", "payload").select("*", key), kept.select(key), "key")
    stored = _packed(likely.drop("key"), "payload").join(kept, ["at", "address"])
    stored.dropDuplicates(["at", "address"]).select("address", "payload").write.parquet(f"{path}/payloads")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and compressed payloads."""
    return spark.read.schema("header binary, address string").parquet(f"{path}/records"), spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")


def _rebuilt(met: DataFrame) -> DataFrame:
    """Records (``header``, ``address``, compressed ``payload``) with the payload opened and found to have its address as digest; another fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for address, held in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = _opened(held.as_py())
                if payload is None or hashlib.sha256(payload).hexdigest() != address:
                    raise ValueError(f"damaged payload {address}")
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payloads, pa.binary())], ["header", "address", "payload"])

    return met.select("header", "address", "payload").mapInArrow(run, "header binary, address string, payload binary")


def _opened(held: bytes | None) -> bytes | None:
    try:
        return None if held is None else zstd.decompress(held)
    except zstd.ZstdError:
        return None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ``header`` and ``payload`` bytes, the payload that of the response for a revisit."""
    records, payloads = _tables(spark, path)
    return _rebuilt(records.join(payloads, "address", "left")).select("header", "payload")


def record_bytes(header: Column, payload: Column) -> Column:
    """A whole record: header block, content (none for a revisit) and the two line ends that close it."""
    content = F.when(field(header, "WARC-Type") == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(header, content, F.lit(b"\r\n\r\n"))


def field(header: Column, name: str) -> Column:
    """The value of a header field, null if the header has none."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive of ``pages``, read it back, rebuild each record, and describe it from its bytes.

    Payloads meet only the responses, whose content they are. A revisit has none; what it says of the payload comes from the response that it revisits,
    once for each address, so a payload that very many pages share moves once. Gives ``page_id``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to``, ``header_digest`` and ``record_bytes``. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archive(pages, path)
    records, payloads = _tables(spark, path)
    is_revisit = field(F.col("header"), "WARC-Type") == "revisit"
    whole = _rebuilt(records.filter(~is_revisit).join(payloads, "address", "left"))
    size, sha1 = F.octet_length("payload").cast("long"), F.sha1("payload")
    responses = whole.select("header", "address", size.alias("payload_bytes"), sha1.alias("payload_digest"), record_bytes(F.col("header"), F.col("payload")).alias("record"))
    responses = saved(responses.select("header", "address", "payload_bytes", "payload_digest", F.octet_length("record").alias("record_bytes")), "warc-responses")
    facts = responses.filter(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).select("address", "payload_bytes", "payload_digest").distinct()
    revisits = records.filter(is_revisit).join(facts, "address", "left").withColumn("record_bytes", F.octet_length(record_bytes(F.col("header"), F.lit(b""))))
    number = lambda name: F.regexp_extract(field(F.col("header"), name), r"<urn:page:(-?[0-9]+)>", 1).cast("long")
    return responses.unionByName(revisits).select(
        number("WARC-Record-ID").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field(F.col("header"), "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        field(F.col("header"), "WARC-Payload-Digest").alias("header_digest"),
        F.col("record_bytes").cast("long").alias("record_bytes"),
    )
