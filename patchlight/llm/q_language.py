"""op1: the language of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .language import identify
from .lm_scoring import remainder


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder("doc_id", 4) == 2
    taught = docs.filter(~held_out).select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), taught).select("doc_id", "held_out", "lang_pred", "score")
