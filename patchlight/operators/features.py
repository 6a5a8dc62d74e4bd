"""Features that need other rows: release windows and citations of fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import advisory_ids, is_release_subject, rx, sha_references
from ..sources.staged import staged
from .diffs import section_path, sections
from .labeling import POSITIVE, SECURITY, apply_lfs


def seed_votes(commits: DataFrame, lfs=POSITIVE) -> DataFrame:
    """Adds ``seed``: whether a positive content function fires. Derived functions never seed.

    Write it (``staged``) before filtering by it: a filter would go down to the texts and run every pattern once more for each of its uses.
    """
    voted = apply_lfs(commits, lfs)
    return voted.select(*commits.columns, (F.greatest(*[F.col(lf.name) for lf in lfs]) == SECURITY).alias("seed"))


def release_windows(rows: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``fires``: a release (``is_release``) with a seed strictly between it and its group's previous release.

    So what comes last before a firing release, of the group's releases and seeds, is a seed. Other rows decide nothing and don't
    move. The rest are dealt out by ranges of group and order (``parts`` of them, by default as many as a shuffle has), so a group of any size,
    all within one day or not, is many tasks'; what is last in a range is handed to the next range that holds the group. Equal places in the
    order must not occur, so ``order`` ends with an id. Nulls count as false.
    """
    spark = rows.sparkSession
    release = F.coalesce(F.col("is_release"), F.lit(False))
    seed = F.coalesce(F.col("seed"), F.lit(False)) & ~release
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter(release | seed).withColumn("__seed", seed).repartitionByRange(parts, F.col(group), *[F.col(c) for c in order])
    events = staged(dealt.withColumn("__part", F.spark_partition_id()), "release-events")
    place = F.struct(*[F.col(c) for c in order])
    last = events.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__at")).agg(F.max_by("__seed", place).alias("__last"))
    carried = last.select("__group", "__at", F.lag("__last").over(Window.partitionBy("__group").orderBy("__at")).alias("__carried"))
    nearest = F.lag("__seed").over(Window.partitionBy(group, "__part").orderBy(*order))
    met = events.withColumn("__nearest", nearest).join(carried, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at")))
    told = met.withColumn("fires", release & F.coalesce("__nearest", "__carried", F.lit(False))).select(*rows.columns, "fires")
    return rows.filter(~(release | seed)).withColumn("fires", F.lit(False)).unionByName(told)


def release_feature(seeded: DataFrame) -> DataFrame:
    """``repo``, ``sha``, ``release_window_positive`` of each commit of ``seeded`` (see ``seed_votes``; written before, as it is read twice)."""
    narrow = seeded.select("repo", "sha", "author_date", "seed", is_release_subject(F.col("subject")).alias("is_release"))
    return release_windows(narrow, "repo", ["author_date", "sha"]).select("repo", "sha", F.col("fires").alias("release_window_positive"))


def changelog_additions(patch: Column) -> Column:
    """Lines that a patch adds to changelogs and notes, joined."""
    notes = F.filter(sections(patch), lambda s: section_path(s).rlike(r"(\.md|\.rst)$|(^|/)\.changeset/|NEWS|CHANGES"))
    lines = F.flatten(F.transform(notes, lambda s: F.split(s, "\n", -1)))
    return F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substr(x, F.lit(2))), "\n")


def citation_features(patches: DataFrame, seeded: DataFrame) -> DataFrame:
    """``sha``, ``patch_cites_advisory``, ``patch_cites_fix_commit`` of release-like or merge commits of ``patches``.

    ``patches`` has ``sha``, ``subject``, ``is_merge`` and ``diff_text``. A commit is cited by the first seven digits of a reference of 7 to
    40; its own don't count. Only the seeded commits' digits meet the references, in a semi-join that the size of both decides.
    """
    asked = patches.filter(is_release_subject(F.col("subject")) | F.coalesce(F.col("is_merge"), F.lit(False)))
    added = asked.select("sha", changelog_additions(F.coalesce(F.col("diff_text"), F.lit(""))).alias("added"))
    prefixes = F.array_distinct(F.transform(sha_references(F.col("added")), lambda x: F.substring(x, 1, 7)))
    references = added.select("sha", F.explode(prefixes).alias("prefix")).filter(F.col("prefix") != F.substring("sha", 1, 7))
    positive = seeded.filter("seed").select(F.substring("sha", 1, 7).alias("prefix"))
    citing = references.join(positive, "prefix", "left_semi").select("sha").distinct().withColumn("cites", F.lit(True))
    return added.join(citing, "sha", "left").select("sha", (F.size(advisory_ids(F.col("added"))) > 0).alias("patch_cites_advisory"), F.coalesce("cites", F.lit(False)).alias("patch_cites_fix_commit"))


def with_features(commits: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """All features on the whole corpus: adds ``release_window_positive``, ``patch_cites_advisory`` and ``patch_cites_fix_commit`` (false without patches)."""
    seeded = staged(seed_votes(commits).select("repo", "sha", "author_date", "subject", "seed"), "seeds")
    fired = release_feature(seeded).filter("release_window_positive").distinct()
    out = commits.join(fired, ["repo", "sha"], "left")
    if patches is not None:
        out = out.join(citation_features(patches, seeded.select("sha", "seed")), "sha", "left")
    absent = [c for c in ("patch_cites_advisory", "patch_cites_fix_commit") if c not in out.columns]
    out = out.withColumns({c: F.lit(False) for c in absent})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("release_window_positive", "patch_cites_advisory", "patch_cites_fix_commit")})


def cites_advisory(text: Column) -> Column:
    return rx(text, v.ADVISORY_ID)
