"""op5: benchmark items inside all documents."""

from pyspark.sql import DataFrame, SparkSession

from .contamination import contained_items


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
grams AS (
  SELECT DISTINCT side, id, g FROM (
    SELECT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                 WHEN len(w) > 0 THEN ['only ' || array_to_string(w, ' ')] END) AS g
    FROM words WHERE id IS NOT NULL)),
sized AS (
  SELECT id, count(*) AS n FROM grams WHERE side = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM grams d JOIN grams i USING (g) WHERE d.side = 'd' AND i.side = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n AS n_item, n_shared / n AS containment FROM shared JOIN sized ON item_id = sized.id WHERE n_shared / n >= 0.8
"""
