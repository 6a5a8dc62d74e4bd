"""op4: groups of similar documents among all documents."""

from pyspark.sql import DataFrame, SparkSession

from .ngram_join import ngram_groups


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, percent=85)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT k, g FROM (
    SELECT k, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i:i + 3], ' ')))
                          WHEN len(w) > 0 THEN [hash('only ' || array_to_string(w, ' '))] END) AS g FROM words)),
sized AS (
  SELECT k, count(*) AS n FROM grams GROUP BY k),
both_ways AS (
  SELECT a.k AS a, b.k AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM both_ways JOIN sized x ON x.k = a JOIN sized y ON y.k = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (
  SELECT k AS start, k AS node FROM words UNION SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.node)
SELECT w.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(v.doc_id) AS component_id,
       (SELECT count(*) FROM links l WHERE l.a = w.k)::BIGINT AS n_links
FROM words w LEFT JOIN sized s ON s.k = w.k JOIN reach r ON r.start = w.k JOIN words v ON v.k = r.node
GROUP BY w.k, w.doc_id
"""
