"""The commit table: parsing of logs, derived columns, gold flags, and its upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..sources.staged import staged

FIELD = "\x1f"
FIELDS = ["sha", "parents", "author_name", "author_email", "author_date", "committer_name", "committer_email", "committer_date", "subject", "body"]


def parse_log(records: DataFrame, value: str = "value") -> DataFrame:
    """Metadata records, fields between 0x1F, as columns; records of fewer than ten fields go."""
    parts = F.split(F.regexp_replace(F.col(value), r"\A[\r\n]+", ""), FIELD, -1)
    cut = records.withColumn("__parts", parts).filter(F.size("__parts") >= len(FIELDS))
    return cut.select(*[c for c in records.columns if c != value], *[F.get("__parts", F.lit(k)).alias(n) for k, n in enumerate(FIELDS)])


def parse_stats(records: DataFrame, value: str = "value") -> DataFrame:
    """File blocks (a sha, then a line per file) as ``sha``, ``files``, ``insertions``, ``deletions``.

    A line is a status and a path (a rename's last path counts), or added, removed and path; ``-`` counts as 0.
    """
    lines = F.split(F.regexp_replace(F.col(value), r"\A[\r\n]+", ""), "\n", -1)
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.contains("\t"))
    cells = F.transform(body, lambda x: F.split(x, "\t", -1))
    number = lambda x, k: F.when(x[0].rlike(r"\A([0-9]+|-)\z") & x[k].rlike(r"\A[0-9]+\z"), x[k].cast("int")).otherwise(0)
    total = lambda k: F.aggregate(cells, F.lit(0), lambda s, x: s + number(x, k))
    keep = [c for c in records.columns if c != value]
    return records.select(*keep, F.trim(lines[0]).alias("sha"), F.transform(cells, lambda x: F.get(x, F.size(x) - 1)).alias("files"), total(0).alias("insertions"), total(1).alias("deletions")).filter("sha <> ''")


def with_stats(metadata: DataFrame, stats: DataFrame) -> DataFrame:
    """Metadata with each commit's files and line counts; none are empty and 0."""
    joined = metadata.join(stats, ["repo", "sha"], "left")
    return joined.withColumns({"files": F.coalesce("files", F.array().cast("array<string>")), "insertions": F.coalesce("insertions", F.lit(0)), "deletions": F.coalesce("deletions", F.lit(0))})


def derived(commits: DataFrame) -> DataFrame:
    """Adds ``message``, ``n_parents``, ``is_merge`` and ``n_files``."""
    parents = F.when(F.trim("parents") == "", 0).otherwise(F.size(F.split(F.trim("parents"), " +")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = commits.withColumns({"message": stripped(F.concat(text("subject"), F.lit("\n\n"), text("body"))), "n_parents": parents, "n_files": F.size(F.coalesce("files", F.array().cast("array<string>")))})
    return out.withColumn("is_merge", F.col("n_parents") > 1)


def history_window(commits: DataFrame, *, since: str | None = None, until: str | None = None, newest: int | None = None) -> DataFrame:
    """Commits of a time span, and of each repository only the newest so many."""
    at = F.to_timestamp("committer_date")
    out = commits
    if since:
        out = out.filter(at >= F.to_timestamp(F.lit(since)))
    if until:
        out = out.filter(at < F.to_timestamp(F.lit(until)))
    return newest_of(out, "repo", at, "sha", newest) if newest else out


def newest_of(rows: DataFrame, group: str, at: Column, id_col: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each group by the time ``at``, null last, equal times by id.

    Counts by day say in which day a group's row ``n`` is, counts by moment within that day in which moment; later ones stay whole, and
    only the rows of that one moment are ranked, each task's first ``n`` of them. So no group is sorted, however large.
    """
    moment = F.coalesce(at, F.lit("0001-01-01").cast("timestamp"))
    keyed = rows.withColumns({"__moment": moment, "__day": F.date_trunc("day", moment)})

    def cut(counted: DataFrame, level: str, wanted: Column) -> DataFrame:
        """The value of ``level`` in which a group's row ``wanted`` is, and how many rows are still wanted of it; none where there are fewer."""
        later = Window.partitionBy("__group").orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, -1)
        summed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(later), F.lit(0)))
        return summed.filter((F.col("__before") < wanted) & (wanted <= F.col("__before") + F.col("__n"))).select("__group", level, (wanted - F.col("__before")).alias("__rest"))

    days = keyed.groupBy(F.col(group).alias("__group"), "__day").agg(F.count(F.lit(1)).alias("__n"))
    of_day = cut(days, "__day", F.lit(n)).withColumnsRenamed({"__day": "__last_day", "__rest": "__wanted"})
    own = keyed.select(F.col(group).alias("__g"), "__day", "__moment").join(of_day, F.col("__g").eqNullSafe(F.col("__group")) & (F.col("__day") == F.col("__last_day")))
    moments = own.groupBy("__group", "__wanted", "__moment").agg(F.count(F.lit(1)).alias("__n"))
    ends = cut(moments, "__moment", F.col("__wanted")).withColumnRenamed("__moment", "__last")
    met = keyed.join(ends, F.col(group).eqNullSafe(F.col("__group")), "left")
    clear = met.filter(F.col("__last").isNull() | (F.col("__moment") > F.col("__last")))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(id_col))
    tied = met.filter(F.col("__moment") == F.col("__last")).withColumn("__rank", rank).filter((F.col("__rank") <= n) & (F.col("__rank") <= F.col("__rest")))
    return clear.select(*rows.columns).unionByName(tied.select(*rows.columns))


def resolve_shas(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds ``full_sha`` to references (``repo_key``, ``commit`` of 7 to 40 hex digits): the one commit that begins so, else the reference itself.

    The first seven digits are a join key, so prefixes never meet in a cross join.
    """
    known = commits.select(F.lower("repo").alias("repo_key"), F.substring("sha", 1, 7).alias("p7"), "sha")
    asked = refs.select("repo_key", "commit").distinct().withColumn("p7", F.substring("commit", 1, 7))
    met = asked.join(known, ["repo_key", "p7"]).filter(F.col("sha").startswith(F.col("commit")))
    one = met.groupBy("repo_key", "commit").agg(F.count(F.lit(1)).alias("n"), F.min("sha").alias("sha")).filter("n = 1").select("repo_key", "commit", "sha")
    return refs.join(one, ["repo_key", "commit"], "left").withColumn("full_sha", F.coalesce("sha", "commit")).drop("sha")


#: A repository's list of CVEs meets so many of its commits in one task, about.
LIST_ROWS = 1 << 13
#: A list is made and stored in pieces of so many CVEs, as readers hold some thousand rows at once; a task sorts about so many CVEs.
LIST_PIECE = 512
RANGE_ROWS = 1 << 16


def flag_fixes(commits: DataFrame, fixes: DataFrame) -> DataFrame:
    """Adds ``is_cve_fix``, ``cve_id`` (the least) and all ``cve_ids`` by ``fixes``: ``repo_key``, ``full_sha``, ``cve_id``."""
    known = fixes.filter("cve_id is not null").groupBy("repo_key", F.lower("full_sha").alias("__sha")).agg(F.array_sort(F.collect_set("cve_id")).alias("cve_ids"))
    keyed = commits.withColumns({"repo_key": F.lower("repo"), "__sha": F.lower("sha")})
    out = keyed.join(known, ["repo_key", "__sha"], "left").withColumns({"is_cve_fix": F.col("cve_ids").isNotNull(), "cve_id": F.get("cve_ids", F.lit(0))})
    return out.withColumn("cve_ids", F.coalesce("cve_ids", F.array().cast("array<string>"))).drop("__sha", "repo_key")


def repo_lists(repo_cves: DataFrame) -> DataFrame:
    """``repo_key`` and ``repo_cve_ids``, a repository's ``cve_ids`` joined by commas."""
    return repo_cves.select("repo_key", F.array_join("cve_ids", ",").alias("repo_cve_ids"))


def list_pieces(pairs: DataFrame) -> DataFrame:
    """As ``repo_lists``, of distinct pairs ``repo_key``, ``cve_id`` that were written before, each list in pieces that follow each other by their first CVEs.

    No task sorts or holds a list of its own: the pairs are dealt out by ranges of both columns, and cut within each.
    """
    n = max(1, -(-pairs.count() // RANGE_ROWS))
    dealt = pairs.repartitionByRange(n, "repo_key", "cve_id").withColumn("__range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("__range", "repo_key").orderBy("cve_id"))
    cut = dealt.withColumn("__piece", F.floor((place - 1) / LIST_PIECE))
    return cut.groupBy("__range", "repo_key", "__piece").agg(F.array_join(F.array_sort(F.collect_list("cve_id")), ",").alias("repo_cve_ids")).select("repo_key", "repo_cve_ids")


def with_repo_lists(commits: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds ``repo_cve_ids`` of ``lists`` (see ``repo_lists`` and ``list_pieces``); a repository without one has the empty text.

    Only lists of repositories that have commits are put together. A list may be far longer than a commit, and few repositories may have most commits. So a repository of many commits is dealt out in parts, to
    each of which its list goes. ``commits`` are narrow rows that were written before, as they are counted first.
    """
    spark = commits.sparkSession
    sizes = commits.groupBy(F.lower("repo").alias("__repo")).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LIST_ROWS))
    parted = staged(sizes.select("__repo", F.ceil(F.col("__n") / LIST_ROWS).alias("__parts")), "repo-parts")
    met = commits.withColumn("__key", F.lower("repo")).join(parted.filter("__parts > 1"), F.col("__key") == F.col("__repo"), "left")
    # The number of tasks is told: narrow rows look small, what they become doesn't.
    dealt = met.withColumn("__part", F.pmod(F.xxhash64("sha"), F.coalesce("__parts", F.lit(1)))).drop("__repo", "__parts").repartition(tasks, "__key", "__part")
    piece = F.struct(F.substring_index("repo_cve_ids", ",", 1).alias("first"), "repo_cve_ids")
    own = lists.join(parted, F.col("repo_key") == F.col("__repo")).groupBy("repo_key", "__parts").agg(F.array_sort(F.collect_list(piece)).alias("__pieces"))
    copies = own.select("repo_key", F.array_join("__pieces.repo_cve_ids", ",").alias("repo_cve_ids"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__of"))
    out = dealt.join(copies, (F.col("__key") == F.col("repo_key")) & (F.col("__part") == F.col("__of")), "left")
    return out.select(*commits.columns, F.coalesce("repo_cve_ids", F.lit("")).alias("repo_cve_ids"))


def flag_gold(commits: DataFrame, fixes: DataFrame, repo_cves: DataFrame) -> DataFrame:
    """Adds ``is_cve_fix``, ``cve_id`` (the least), all ``cve_ids``, and the repository's CVEs ``repo_cve_ids`` joined by commas.

    fixes: ``repo_key``, ``full_sha``, ``cve_id``; repo_cves: ``repo_key``, ``cve_ids``.
    """
    return with_repo_lists(staged(flag_fixes(commits, fixes), "flagged"), repo_lists(repo_cves))


def distinct_commits(commits: DataFrame) -> DataFrame:
    return commits.dropDuplicates(["repo", "sha"])


def repo_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_if("is_cve_fix").alias("gold"))


def collapse_backports(commits: DataFrame) -> DataFrame:
    """One row per repository and subject: how many commits carry it, the first date, all their shas, and that of the first of them (the least of equal dates)."""
    first = F.min_by("sha", F.struct("author_date", "sha"))
    shas = F.array_join(F.array_sort(F.collect_set("sha")), ",")
    return commits.groupBy("repo", "subject").agg(F.count(F.lit(1)).alias("n"), F.min("author_date").alias("first_date"), shas.alias("shas"), first.alias("representative"))


def backport_members(commits: DataFrame) -> DataFrame:
    """``sha``, ``repo``, ``representative`` of every commit: rows instead of lists, so that a subject of very many commits is no one row's."""
    groups = collapse_backports(commits).select(F.col("repo").alias("r"), F.col("subject").alias("s"), "representative")
    return commits.join(groups, F.col("repo").eqNullSafe(F.col("r")) & F.col("subject").eqNullSafe(F.col("s"))).select("sha", "repo", "representative")


def is_release_only(paths: Column) -> Column:
    """Whether a commit's changed paths hold no code; false without paths."""
    from ..functions.text import is_code_path

    return (F.size(paths) > 0) & ~F.exists(paths, is_code_path)
