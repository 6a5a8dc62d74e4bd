"""op8: language-model scores of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .lm_scoring import remainder, score


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, remainder("doc_id", 7) == 2)
