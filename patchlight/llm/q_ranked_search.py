"""op12: the ten best documents for each benchmark item."""

from pyspark.sql import DataFrame, SparkSession

from .ranked_search import search


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
q AS (
  SELECT row_number() OVER () AS k, item_id,
         list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
total AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
postings AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) GROUP BY k, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
sizes AS (SELECT k, doc_id, 10 + (90 * len(t) * n) // l AS m FROM d, total WHERE len(t) > 0),
scores AS (
  SELECT q.k, q.item_id, p.k AS d, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * s.m)))::BIGINT AS score
  FROM (SELECT k, item_id, unnest(t) AS term FROM q) q JOIN postings p USING (term) JOIN weights w USING (term) JOIN sizes s ON s.k = p.k
  GROUP BY q.k, q.item_id, p.k),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY scores.k ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores JOIN sizes ON sizes.k = scores.d WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
