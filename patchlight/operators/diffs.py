"""Patches: sections, hunks, lines, paths and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_doc_path

PATCH_CHARS = 512_000
SECTION_CHARS = 200_000
HUNK_CHARS = 200_000
LINE_CHARS = 500


def sections(patch: Column) -> Column:
    """A patch cut before each file header; what stands before the first is a section too."""
    return F.split(patch, r"(?dm)^(?=diff --git )", -1)


def section_path(section: Column) -> Column:
    """The new path in a section's header: what follows the first `` b/``; empty without it."""
    return F.regexp_extract(section, r"(?d)\Adiff --git .*? b/(.*)", 1)


def prefiltered(patch: Column) -> Column:
    """The patch without sections that have no path, document something, or are too long; then cut to the largest size."""
    # A section that another follows ends with the line break between them, which isn't its own.
    parts = sections(patch)
    own = F.transform(parts, lambda s, i: F.when(i < F.size(parts) - 1, F.regexp_replace(s, r"(?d)\n\z", "")).otherwise(s))
    kept = F.filter(own, lambda s: (section_path(s) != "") & ~is_doc_path(section_path(s)) & (F.length(s) <= SECTION_CHARS))
    return F.substring(F.array_join(kept, "\n"), 1, PATCH_CHARS)


def with_hunks(commits: DataFrame, patch: str = "diff_text") -> DataFrame:
    """Adds ``diff_added`` and ``diff_removed``: the lines that a patch adds and removes, without their signs.

    Merges have none. Lines of documents, file headers and lines of more than 500 characters are skipped, and lines stop once more
    than 200,000 characters are kept; the line that passes the limit is the last.
    """
    merge = F.coalesce(F.col("is_merge"), F.lit(False))
    text = F.when(merge, "").otherwise(F.coalesce(F.col(patch), F.lit("")))
    shown = F.filter(sections(text), lambda s: ~is_doc_path(section_path(s)))
    lines = F.flatten(F.transform(shown, lambda s: F.split(s, "\n", -1)))
    changed = F.filter(lines, lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)") & (F.length(x) <= LINE_CHARS))
    with_lines = commits.withColumn("__lines", changed)
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"))
    step = lambda s, x: F.when(s["chars"] <= HUNK_CHARS, F.struct((s["chars"] + F.length(x)).alias("chars"), (s["n"] + 1).alias("n"))).otherwise(s)
    within = with_lines.withColumn("__n", F.aggregate("__lines", start, step, lambda s: s["n"]))
    kept = within.withColumn("__kept", F.slice("__lines", F.lit(1), F.col("__n")))

    def side(sign: str) -> Column:
        return F.array_join(F.transform(F.filter("__kept", lambda x: x.startswith(sign)), lambda x: F.substr(x, F.lit(2))), "\n")

    return kept.withColumns({"diff_added": side("+"), "diff_removed": side("-")}).drop("__lines", "__n", "__kept")


def diff_lines(commits: DataFrame, patch: str = "diff_text") -> DataFrame:
    """One row per line of each file's section: ``sha``, ``path``, ``file_pos``, ``line_pos``, ``sign``, ``text``."""
    files = commits.select("sha", F.posexplode(F.filter(sections(F.col(patch)), lambda s: s.startswith("diff --git "))).alias("file_pos", "section"))
    lines = files.select("sha", "file_pos", section_path(F.col("section")).alias("path"), F.posexplode(F.split(F.regexp_replace("section", r"(?d)\n\z", ""), "\n", -1)).alias("line_pos", "line"))
    sign = F.when(F.col("line").rlike(r"^(\+\+\+|---)"), "h").when(F.col("line").startswith("+"), "+").when(F.col("line").startswith("-"), "-").otherwise(" ")
    return lines.select("sha", "path", "file_pos", "line_pos", sign.alias("sign"), F.col("line").alias("text"))


def changed_paths(patch: Column) -> Column:
    """Distinct new paths in order of their headers."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?dm)^diff --git a/.* b/(.*)$"), F.lit(1)))


def excerpt(commits: DataFrame, patch: str = "diff_text", *, files: int = 20, file_lines: int = 150, commit_lines: int = 600, file_chars: int = 40_000, header_lines: int = 4) -> DataFrame:
    """A bounded part of each patch: ``sha``, ``n_files``, ``n_files_shown``, ``n_lines``, ``n_lines_shown``, ``excerpt``.

    The first files, the first lines of each (four if the file's section is very long), lines cut to 500 characters, and so many
    lines of a commit.
    """
    lines = diff_lines(commits, patch)
    whole = lines.withColumn("chars", F.sum(F.length("text") + 1).over(Window.partitionBy("sha", "file_pos")) - 1)
    most = F.when(F.col("chars") > file_chars, header_lines).otherwise(file_lines)
    shown = whole.withColumn("fits", (F.col("file_pos") < files) & (F.col("line_pos") < most))
    order = Window.partitionBy("sha").orderBy("file_pos", "line_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = shown.withColumn("shown", F.col("fits") & (F.sum(F.col("fits").cast("int")).over(order) <= commit_lines))
    text = F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("file_pos", "line_pos", F.substring("text", 1, LINE_CHARS).alias("text")))))
    return shown.groupBy("sha").agg(
        F.count_distinct("file_pos").alias("n_files"),
        F.count_distinct(F.when(F.col("shown"), F.col("file_pos"))).alias("n_files_shown"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("shown").alias("n_lines_shown"),
        F.array_join(F.transform(text, lambda x: x["text"]), "\n").alias("excerpt"),
    )
