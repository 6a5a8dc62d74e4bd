"""Commits laid out by repository: one repository is read from one bucket, and counts and duplicates by repository need no shuffle."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staged import new_path


#: A bucket holds about so many rows at most: a larger table has more buckets, not larger ones.
BUCKET_ROWS = 1 << 14


def _bucket(repo: Column, buckets: int) -> Column:
    """The bucket that a bucketed write by ``repo`` chooses, so that a partition of this number holds one bucket."""
    return F.pmod(F.hash(repo), F.lit(buckets))


@dataclass(frozen=True)
class CommitStore:
    """Two tables of the catalog: of most repositories by ``repo_bucket``, and of the few ``hot`` ones by ``repo``, each in buckets of shas.

    A repository is hot if it has over a bucket's fair share of the rows, so there are fewer of them than buckets, and no bucket is far
    larger than another.
    """

    spark: SparkSession
    cold: str
    hot: str
    hot_repos: tuple[str, ...]
    buckets: int

    @classmethod
    def write(cls, commits: DataFrame, buckets: int = 64, name: str | None = None) -> CommitStore:
        """``commits`` (a column ``repo``, which may be null, and ``sha``) as two external tables in the shared folder, in ``buckets`` or, if they are many rows, more."""
        spark, name = commits.sparkSession, name or f"commits_{uuid.uuid4().hex}"
        sizes = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets = max(buckets, -(-total // BUCKET_ROWS))
        large = sizes.filter((F.col("n") * buckets > total) & (F.col("n") > 1) & F.col("repo").isNotNull())
        hot = tuple(sorted(r["repo"] for r in large.select("repo").toLocalIterator()))
        is_hot = F.coalesce(F.col("repo").isin(*hot), F.lit(False)) if hot else F.lit(False)
        store = cls(spark, name, f"{name}_hot", hot, buckets)
        rows = commits.filter(~is_hot).withColumn("repo_bucket", _bucket(F.col("repo"), buckets)).repartition(buckets, "repo")
        rows.write.partitionBy("repo_bucket").bucketBy(buckets, "repo").sortBy("repo", "sha").option("path", new_path(spark, name)).saveAsTable(store.cold)
        rows = commits.filter(is_hot).repartition(buckets, "sha")
        rows.write.partitionBy("repo").bucketBy(buckets, "sha").sortBy("sha").option("path", new_path(spark, name)).saveAsTable(store.hot)
        return store

    def _parts(self) -> list[DataFrame]:
        return [self.spark.table(self.cold).drop("repo_bucket"), *([self.spark.table(self.hot)] if self.hot_repos else [])]

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def rows(self) -> DataFrame:
        return self._union(self._parts())

    def view(self, repo: str) -> DataFrame:
        """One repository's commits: one partition is scanned."""
        if repo in self.hot_repos:
            return self.spark.table(self.hot).filter(F.col("repo") == repo).select(*self.spark.table(self.cold).drop("repo_bucket").columns)
        bucket = self.spark.range(1).select(_bucket(F.lit(repo), self.buckets)).first()[0]
        return self.spark.table(self.cold).filter((F.col("repo_bucket") == bucket) & (F.col("repo") == repo)).drop("repo_bucket")

    def distinct(self) -> DataFrame:
        """One row for each repository and sha. Both tables hold the rows of a pair in one bucket, so nothing is shuffled."""
        return self._union([p.dropDuplicates(["repo", "sha"]) for p in self._parts()])

    def counts(self, gold: str) -> DataFrame:
        """Per ``repo`` its ``commits`` and ``gold`` ones. Only the hot repositories' partial counts, a row per bucket, are shuffled."""
        flag = F.coalesce(F.col(gold), F.lit(False))
        return self._union([p.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_if(flag).alias("gold")) for p in self._parts()])

    def drop(self) -> None:
        for table in (self.cold, self.hot):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
