"""A corpus made ready for training: five stages over ``documents``, each with one of the operators of the llm subpackage.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.llm.bits import parted, without
from patchlight.llm.contamination import contained_items
from patchlight.llm.language import UNDETERMINED, identify
from patchlight.llm.lm_scoring import remainder
from patchlight.llm.mixing import mix
from patchlight.llm.ngram_join import ngram_groups
from patchlight.llm.q_quality import LEAST_TOP, ratings
from patchlight.llm.quality import rate
from patchlight.llm.sample import unused
from patchlight.llm.storage import saved

#: A text whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.4
#: Texts go to Python in batches of so many bytes (and a row), not of 10,000 rows whatever their length: an executor holds several copies of each task's batch beside its heap.
BATCH_BYTES = 1 << 21

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage, with batches of ``BATCH_BYTES`` in its session unless that sets a size of its own."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


def _key(docs: DataFrame) -> Column:
    """A row's own key, from its id and text, so that null and repeated ids are judged by their texts; rows equal in both share it."""
    return F.xxhash64("doc_id", "text")


@small_batches
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that have letters and a language that is likely enough.

    A null or empty text goes; repeated rows fare alike; without labelled texts nothing can be told, so all go; an empty table stays empty.
    """
    taught = docs.filter(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang")
    judged = identify(docs, taught)
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


@small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that are more likely of the best grade than not; toxic ones have the lowest.

    A null text is judged by the thresholds alone, repeated rows alike; without ratings all stay; an empty table stays empty.
    """
    graded = rate(docs, ratings(spark, sf_dir))
    return graded.filter(F.col("p_top") >= LEAST_TOP).select(*docs.columns)


@small_batches
def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the smallest id.

    Where ids are null (which come last) or repeated, the key of id and text decides; of rows that repeat both one stays. Texts
    without words are in no group and stay, repeated or not; an empty table stays empty.
    """
    key = unused("key", docs.columns)
    keyed = docs.withColumn(key, _key(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    groups = ngram_groups(keyed.select(place.alias("doc_id"), "text"), shingle_words=5, percent=80).filter("n_shingles > 0")
    groups = saved(groups.select(F.col("doc_id.key").alias(key), (F.col("doc_id") != F.col("component_id")).alias("goes")), "near-copies")
    marks = groups.groupBy(key).agg(F.bool_or("goes").alias("goes"), F.count(F.lit(1)).alias("n")).filter("goes OR n > 1")
    marks = saved(marks.select(F.col(key).alias("marked"), "goes"), "near-copy-marks")
    # Only rows that may be marked move: those that go, and those of which one stays.
    clear, suspect = parted(keyed, marks, key, "marked")
    met = suspect.alias("d").join(marks.alias("m"), F.col(f"d.{key}") == F.col("m.marked"), "left").filter("m.goes IS NULL OR NOT m.goes")
    one = F.when(F.col("m.goes").isNull(), F.monotonically_increasing_id())
    once = met.select("d.*", one.alias(unused("row", keyed.columns))).dropDuplicates([key, unused("row", keyed.columns)])
    return clear.unionByName(once.select(*keyed.columns)).select(*docs.columns)


@small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold a benchmark item, each row judged by its own text.

    Null and empty texts hold none and stay; repeated rows fare alike; an empty table, here or of items, changes nothing.
    """
    key = unused("key", docs.columns)
    keyed = docs.withColumn(key, _key(docs))
    found = contained_items(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(keyed, saved(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated"), key).select(*docs.columns)


@small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds how often the mix takes each document (``copies``, ``taken`` words) and its source's target; those that it doesn't take go.

    A null text has no words, and a null source is the last; an empty table stays empty.
    """
    return mix(docs).filter(F.col("copies") > 0)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first two stages are trained models, which SQL can't express.
ORACLE_SQL = None
