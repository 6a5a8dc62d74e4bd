"""Exact, seeded samples: rows in the order of a hash of their id, so that any engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def sample(rows: DataFrame, n: int, seed: int | str = 42, key: str = "sha") -> DataFrame:
    """``n`` rows without replacement. Each partition keeps its first ``n`` before they meet."""
    return rows.orderBy(draw(seed, key), key).limit(n)


def stratified(commits: DataFrame, control: int, *, gold: str = "is_cve_fix", positive: str = "seed", seed: int | str = 42) -> DataFrame:
    """All gold rows, all others with a positive vote, and ``control`` of the rest; adds ``stratum``."""
    g, p = F.coalesce(F.col(gold), F.lit(False)), F.coalesce(F.col(positive), F.lit(False))
    kinds = commits.withColumn("stratum", F.when(g, "gold").when(p, "positive").otherwise("control"))
    rest = sample(kinds.filter("stratum = 'control'"), control, seed)
    return kinds.filter("stratum <> 'control'").unionByName(rest)


def attached(rows: DataFrame, sample: DataFrame, key: str = "sha") -> DataFrame:
    """``rows`` of a sample with the sample's columns; a sampled row that ``rows`` lacks fails the job, so that nothing is lost unseen."""
    there = "__there"
    joined = sample.join(rows.withColumn(there, F.lit(True)), key, "left")
    kept = F.when(F.col(there), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("sampled row is not in the table: "), F.col(key))))
    return joined.withColumn(key, kept).drop(there)


def stratum_sizes(drawn: DataFrame, patch: str = "diff_text") -> DataFrame:
    """Per stratum its rows, characters of patches, and empty patches."""
    text = F.coalesce(F.col(patch), F.lit(""))
    return drawn.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"), F.count_if(text == "").alias("empty"))


def review_sample(labelled: DataFrame, n: int, *, seed: int | str = 42, prob: str = "prob_security", label: str = "label") -> DataFrame:
    """``n`` rows labeled security for a person to read, most probable first, with an empty ``verdict``."""
    return sample(labelled.filter(F.col(label) == 1), n, seed).withColumn("verdict", F.lit("")).orderBy(F.desc(prob), "sha")
