"""Packed dumps: very many commits' records a file, which Spark's text source splits at the records' ends wherever the file is stored.

A record ends with 0x1E, its fields are parted by 0x1F. What the values hold of these two, or of the mark that stands for them, is
written as a mark and a letter, so every value comes back as it was, null too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import FIELDS

RECORD, FIELD, MARK = "\x1e", "\x1f", "\x10"
_LETTERS = {MARK: "P", RECORD: "R", FIELD: "F", "\r": "C"}
#: A null value.
_NULL = f"{MARK}N"


def marked(value: Column) -> Column:
    out = value.cast("string")
    for sign, letter in _LETTERS.items():
        out = F.replace(out, F.lit(sign), F.lit(MARK + letter))
    return F.coalesce(out, F.lit(_NULL))


def unmarked(text: Column) -> Column:
    out = text
    for sign, letter in reversed(_LETTERS.items()):
        out = F.replace(out, F.lit(MARK + letter), F.lit(sign))
    return F.when(text != _NULL, out)


def write_dump(rows: DataFrame, columns: list[str], path: str) -> None:
    """The ``columns`` (of strings, or what casts to them) of all rows, as many records a file as a task has rows."""
    rows.select(F.concat_ws(FIELD, *[marked(F.col(c)) for c in columns]).alias("value")).write.option("lineSep", RECORD).text(path)


def read_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The records of dumps under ``path`` as string columns. Records of fewer fields go; further fields are ignored."""
    parts = F.split("value", FIELD, -1)
    cut = spark.read.option("lineSep", RECORD).text(path).select(parts.alias("p")).filter(F.size("p") >= len(columns))
    return cut.select(*[unmarked(F.get("p", F.lit(k))).alias(c) for k, c in enumerate(columns)])


def write_log_dump(commits: DataFrame, path: str) -> None:
    """Metadata: the repository, then the ten fields of a log record."""
    write_dump(commits, ["repo", *FIELDS], path)


def read_log_dump(spark: SparkSession, path: str) -> DataFrame:
    return read_dump(spark, path, ["repo", *FIELDS])


def write_stats_dump(commits: DataFrame, path: str) -> None:
    """Files and line counts: repository, sha, and a block with a line per file, of which the first has all that was added and removed."""
    count = lambda i, c: F.when(i == 0, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("string")
    lines = F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f, i: F.concat_ws("\t", count(i, "insertions"), count(i, "deletions"), f))
    write_dump(commits.select("repo", "sha", F.array_join(lines, "\n").alias("block")), ["repo", "sha", "block"], path)


def read_stats_dump(spark: SparkSession, path: str) -> DataFrame:
    """``repo`` and ``value``, a file block as ``parse_stats`` reads it."""
    return read_dump(spark, path, ["repo", "sha", "block"]).select("repo", F.concat_ws("\n", "sha", F.lit(""), "block").alias("value"))


def write_patch_dump(patches: DataFrame, path: str) -> None:
    """Patches: repository, sha and text, instead of one file for each, which the driver would have to list."""
    write_dump(patches, ["repo", "sha", "diff_text"], path)


def read_patch_dump(spark: SparkSession, path: str) -> DataFrame:
    return read_dump(spark, path, ["repo", "sha", "diff_text"])
