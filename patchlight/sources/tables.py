"""Readers and writers of landed data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


#: A table whose scan has more partitions than this, each of a file split's size, isn't moved for the sake of idle cores.
FEW_PARTITIONS = 16


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in at least as many partitions as there are cores, if they are few: a small table's scan would leave cores idle, a large one isn't moved."""
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows.repartition(cores) if parts < cores and parts <= FEW_PARTITIONS else rows


def read_commits(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The commit table, from Parquet or JSON lines."""
    reader = spark.read.schema(schemas.COMMITS)
    return reader.parquet(path) if kind == "parquet" else reader.json(path)


def write_rows(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows with lists, as Parquet or JSON lines; CSV can't hold lists."""
    getattr(rows.write.mode("errorifexists"), kind)(path)


def write_commit_table(flagged: DataFrame, lists: DataFrame, path: str, kind: str = "parquet") -> None:
    """Commits with their own flags, and beside them the repositories' lists of CVEs, once each, in one row or in pieces: a list is far longer than a commit."""
    columns = [c for c in (x.split(" ")[0] for x in schemas.COMMITS.split(", ")) if c != "repo_cve_ids"]
    write_rows(flagged.select(*columns), f"{path}/commits", kind)
    write_rows(lists.select("repo_key", "repo_cve_ids"), f"{path}/lists", kind)


def read_commit_table(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """The commits of a written table, without ``repo_cve_ids``, and the lists that ``commits.with_repo_lists`` adds to them."""
    return read_commits(spark, f"{path}/commits", kind).drop("repo_cve_ids"), getattr(spark.read.schema(schemas.REPO_LISTS), kind)(f"{path}/lists")


def read_cves(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; of several with one id the last published stays."""
    rows = spark.read.schema(schemas.CVES).json(path)
    return rows.groupBy("cve_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "cve_id"]), F.struct("last_modified", "published")).alias("x")).select("cve_id", "x.*")


def read_nvd_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NVD_PAGE).json(path)


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OSV).json(path)


def write_targets(targets: DataFrame, path: str, each: int = 1000) -> None:
    """The index of repositories as nested documents of about ``each`` repositories, a document a line: no row holds them all."""
    parts = -(-max(targets.count(), 1) // each)
    part = F.pmod(F.xxhash64("repo_key"), F.lit(parts))
    targets.groupBy(part.alias("part")).agg(F.collect_list(F.struct(*targets.columns)).alias("targets")).select("targets").write.json(path)


def read_targets(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The repositories of all documents under ``path``: one a line, or (``whole``) one a file, over as many lines as it likes."""
    return spark.read.schema(schemas.TARGETS).option("multiLine", whole).json(path).select(F.explode("targets").alias("x")).select("x.*")


def read_log_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log dump, each ended by 0x1E, as ``value``."""
    return spark.read.option("lineSep", "\x1e").text(path).filter(F.col("value").rlike(r"\S"))


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """One patch per file, named by its commit: ``sha``, ``diff_text``."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"([0-9a-f]{7,40})", 1).alias("sha"), F.col("value").alias("diff_text"))


def read_patch_sample(spark: SparkSession, path: str) -> DataFrame:
    """A written sample of patches: ``sha``, ``repo``, ``stratum``, ``diff_text``."""
    return spark.read.schema(schemas.PATCHES).parquet(path).withColumnRenamed("diff", "diff_text")


def read_citations(spark: SparkSession, path: str | None, commits: DataFrame) -> DataFrame:
    """Commits with their citation columns; without the table both are false."""
    names = ["patch_cites_advisory", "patch_cites_fix_commit"]
    if path is None:
        return commits.withColumns({c: F.lit(False) for c in names})
    joined = commits.join(spark.read.schema(schemas.CITATIONS).parquet(path), "sha", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in names})


def write_review(rows: DataFrame, path: str) -> None:
    """A sample for a person to read, as one CSV file with a header."""
    rows.coalesce(1).write.option("header", True).csv(path)
