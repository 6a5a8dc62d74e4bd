"""op11: five filters over all documents, in all orders."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filter_audit import audit, text_failures


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = text_failures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    return audit(failures.join(labels, "doc_id", "left"), "part", {"A": "short", "B": "poor", "C": "loud", "D": "symbols", "E": "copy"}, ["good", "toxic"])


OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM t),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT x, min(doc_id) AS first FROM t GROUP BY x),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
           WHEN 'A' THEN len(words) < 100
           WHEN 'B' THEN 100 * len(list_distinct(words)) < 80 * len(words)
           WHEN 'C' THEN 100 * len(regexp_extract_all(w.x, '[A-Z]')) > 10 * length(w.x)
           WHEN 'D' THEN regexp_matches(w.x, '[#$%&*|]')
           ELSE coalesce(w.doc_id > least.first, false) END) AS f
  FROM w LEFT JOIN least ON w.x = least.x LEFT JOIN marks ON w.doc_id = marks.doc_id),
letter(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT [v.a, w.a, x.a, y.a, z.a] AS o FROM letter v, letter w, letter x, letter y, letter z
  WHERE len(list_distinct([v.a, w.a, x.a, y.a, z.a])) = 5),
steps AS (
  SELECT array_to_string(o, '') AS filter_order, s AS step, o[s] AS own, o[:s - 1] AS before FROM orders, range(1, 6) r(s)),
cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, f),
found AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         coalesce(sum(n) FILTER (WHERE NOT list_has_any(f, before) AND NOT list_contains(f, own)), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE list_has_any(f, before) AND list_contains(f, own)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE f = [own]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM found
"""
