"""op7: the expected grade of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import grade_of, rate

#: Select a document whose tail probability of the highest grade reaches this.
LEAST_TOP = 0.5


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    graded = rate(docs, ratings(spark, sf_dir))
    return graded.select("doc_id", "expected_grade", "p_top", "p_bottom", (F.col("p_top") >= LEAST_TOP).alias("selected"))
