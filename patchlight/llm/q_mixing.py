"""op10: the mix of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(k % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM sources),
levelled AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed),
reached AS (
  SELECT *, (SELECT first(level ORDER BY cap / weight, k) FROM levelled WHERE cap >= level * weight) AS reached FROM levelled),
goals AS (
  SELECT source, source_size, least(cap::DOUBLE, reached * weight) AS target FROM reached),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goals),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS part,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id NULLS LAST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2 AS so_far
  FROM sized s JOIN parts g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN part > 0 AND so_far <= part THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""
