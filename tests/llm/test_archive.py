import hashlib

import pytest
from pyspark.sql import functions as F

from patchlight.llm.archive import archive_pages, read_archive, record_bytes, write_archive

PAGES = "page_id long, url string, html string, other string"


@pytest.fixture(scope="module")
def pages(spark):
    big, small = "\u00e9" * 600, "tiny"
    rows = [(1, "http://a/", big, "x"), (5, "http://b/\r\nX: y", big, None), (3, None, big, "x"), (2, "u", small, "x"), (4, "u", small, "x"), (6, "u", None, "x"), (7, "u", "", "x"), (7, "u", "", "x"), (None, "u", "n" * 2000, "x")]
    return spark.createDataFrame(rows, PAGES)


def test_roles_and_digests(pages):
    got = {r["page_id"]: r for r in archive_pages(pages).collect()}
    big = ("\u00e9" * 600).encode()
    assert (got[5]["record_type"], got[5]["refers_to"]) == ("response", None)
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in (1, 3)] == [("revisit", 5)] * 2
    assert all(got[k]["record_type"] == "response" for k in (2, 4, 6, 7, None))
    assert got[1]["payload_bytes"] == 1200 and got[1]["payload_digest"] == hashlib.sha1(big).hexdigest()
    assert all(r["header_digest"] == "sha1:" + r["payload_digest"] for r in got.values())
    assert got[6]["payload_bytes"] == 0 and archive_pages(pages).count() == pages.count()


def test_round_trip_is_exact_and_stores_a_payload_once(spark, pages, tmp_path):
    write_archive(pages, str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w/payloads"))
    assert stored.count() == stored.select("address").distinct().count() == 4
    assert {r["address"] for r in stored.collect()} == {hashlib.sha256((h or "").encode()).hexdigest() for (h,) in pages.select("html").collect()}
    whole = read_archive(spark, str(tmp_path / "w")).select(record_bytes(F.col("header"), F.col("payload")).alias("b"), "payload").collect()
    want = sorted((h or "").encode() for (h,) in pages.select("html").collect())
    assert sorted(bytes(r["payload"]) for r in whole) == want
    for r in whole:
        head, _, content = bytes(r["b"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and content.endswith(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert len(content) - 4 == length


def test_headers_name_what_a_reader_asks_for(spark, pages, tmp_path):
    write_archive(pages, str(tmp_path / "h"), date="2024-05-06T07:08:09Z")
    heads = [bytes(r["header"]).decode() for r in spark.read.parquet(str(tmp_path / "h/records")).collect()]
    assert all("\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n" in h for h in heads)
    assert sum("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in h for h in heads) == sum("WARC-Type: revisit" in h for h in heads) == 2
    assert sum("WARC-Target-URI: http://b/%0D%0AX: y\r\n" in h for h in heads) == 1


def test_very_long_and_repeated_payloads(spark):
    rows = [(k, "u", "long " * 400_000 if k % 2 else "\x00\ud7ff" * 700, "x") for k in range(6)]
    got = {r["page_id"]: r for r in archive_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[k]["refers_to"] for k in range(6)] == [4, 5, 4, 5, None, None]
    assert got[1]["payload_bytes"] == 2_000_000 and got[1]["record_bytes"] < 1000 < 2_000_000 < got[5]["record_bytes"]


def test_damage_is_found(spark, pages, tmp_path):
    write_archive(pages, str(tmp_path / "d"))
    zstd = __import__("zstandard")
    spark.read.parquet(str(tmp_path / "d/payloads")).withColumn("payload", F.lit(zstd.compress(b"no"))).write.parquet(str(tmp_path / "d2/payloads"))
    spark.read.parquet(str(tmp_path / "d/records")).write.parquet(str(tmp_path / "d2/records"))
    with pytest.raises(Exception, match="damaged payload"):
        read_archive(spark, str(tmp_path / "d2")).collect()


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0
