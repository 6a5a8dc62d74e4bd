"""Votes on commits as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.labeling import MESSAGE, apply_lfs
from ..sources import schemas


def commit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Commits from JSON lines that land in a folder."""
    return spark.readStream.schema(schemas.COMMITS).json(path)


def voted(stream: DataFrame) -> DataFrame:
    """Message votes need one row only, so the same columns serve a stream without state."""
    return apply_lfs(stream, MESSAGE).select("repo", "sha", *[lf.name for lf in MESSAGE])
