"""Registered queries: each applies one operator, or a few, to tables made of the given ones."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..operators import advisories as adv
from ..operators import audit, combine, features, labeling, measure, sampling, text_model
from ..operators import commits as cm
from ..operators import diffs as df_ops
from ..sources import dumps, schemas, tables
from ..sources.commit_store import CommitStore
from ..sources.staged import new_path, staged
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
MESSAGE = {lf.name: lf.polarity for lf in labeling.MESSAGE}
VOTES = list(fx.POLARITY)
POSITIVE = [c for c, p in fx.POLARITY.items() if p == 1]
NEGATIVE = [c for c, p in fx.POLARITY.items() if p == 0]
#: Class prior of the vote matrix, and so the probability above which votes speak for a row.
PRIOR = 0.4
CUTS = (0.9, 0.75, 0.5, 0.3, 0.27, 0.2, 0.1)
#: A label model with given parameters, so that what follows from them can be compared with SQL: P(vote | class), and the prior.
GIVEN_VOTES = {"lf_returned": (0.30, 0.20), "lf_large": (0.35, 0.15), "lf_discounted": (0.40, 0.22), "lf_open": (0.30, 0.55), "lf_taxed": (0.25, 0.35), "lf_first_line": (0.20, 0.28)}
GIVEN_PRIOR = 0.3


def lf_votes(spark: SparkSession, sf: str) -> DataFrame:
    voted = labeling.apply_lfs(fx.commits(spark, sf), labeling.MESSAGE)
    return voted.select("sha", *MESSAGE, combine.majority(list(MESSAGE)).alias("mv_label"))


def lf_summary(spark: SparkSession, sf: str) -> DataFrame:
    return measure.lf_table(labeling.apply_lfs(fx.commits(spark, sf), labeling.MESSAGE), MESSAGE, "is_gold")


def release_window(spark: SparkSession, sf: str) -> DataFrame:
    seeded = features.seed_votes(fx.commits(spark, sf)).select("repo", "sha", "author_date", "subject", "seed")
    return features.release_feature(staged(seeded, "seeds"))


def release_log(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("is_release"), (F.col("event_type") == "error").alias("seed"))
    return features.release_windows(e, "user_id", ["ts", "event_id"]).select("event_id", "fires")


def hunks(spark: SparkSession, sf: str) -> DataFrame:
    return df_ops.with_hunks(fx.commits(spark, sf))


def diff_votes(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.apply_lfs(hunks(spark, sf), labeling.DIFF).select("sha", *[lf.name for lf in labeling.DIFF])


def changed_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = fx.commits(spark, sf).select("sha", df_ops.changed_paths(F.col("diff_text")).alias("p"))
    return paths.select("sha", F.array_join("p", "|").alias("paths"), cm.is_release_only(F.col("p")).alias("release_only"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    commits = fx.commits(spark, sf)
    return features.citation_features(commits, staged(features.seed_votes(commits).select("sha", "seed"), "seeds"))


def strata(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The stratified sample, with ``columns`` of the commits (all, if none is named); seeds are voted once and written with them."""
    seeded = features.seed_votes(fx.commits(spark, sf))
    return sampling.stratified(staged(seeded.select(*columns, "seed") if columns else seeded, "seeded"), 200, gold="is_gold")


def control_rates(spark: SparkSession, sf: str) -> DataFrame:
    voted = labeling.apply_lfs(strata(spark, sf), labeling.POSITIVE)
    return measure.control_rates(voted, [lf.name for lf in labeling.POSITIVE])


def all_lfs(spark: SparkSession, sf: str) -> DataFrame:
    """All 42 functions over the whole corpus with its features, and their summary. Messages are read once: their facts are written, and seeds and votes both follow from those."""
    facts = labeling.message_facts(fx.commits(spark, sf))
    commits = staged(facts.drop("message", "body", "fact_m", "fact_low", "fact_s"), "facts")
    voted = labeling.apply_lfs(df_ops.with_hunks(features.with_features(commits, commits)), labeling.ALL_WITH_DIFF)
    return measure.lf_table(voted, {lf.name: lf.polarity for lf in labeling.ALL_WITH_DIFF}, "is_gold")


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """Message votes on commits, their majority, what the difference of votes makes of them, and whether a commit changes code."""
    code = ~cm.is_release_only(df_ops.changed_paths(F.col("diff_text")))
    voted = labeling.apply_lfs(fx.commits(spark, sf).withColumn("is_code", code), labeling.MESSAGE)
    names = list(MESSAGE)
    counted = voted.withColumns({"mv_label": combine.majority(names), "n_positive": combine.n_votes(names, 1), "n_negative": combine.n_votes(names, 0)})
    difference = (F.col("n_positive") - F.col("n_negative")).cast("double") / 10 + 0.5
    return counted.withColumn("prob_security", difference).withColumn("label", F.when(F.expr("n_positive + n_negative = 0"), -1).when(F.col("prob_security") >= 0.6, 1).otherwise(0).cast("tinyint"))


def message_names(vote: int) -> list[str]:
    return [c for c, p in MESSAGE.items() if p == vote]


def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    return measure.gold_detail(coded(spark, sf), MESSAGE, "sha", others=["prob_security", "label", "is_code"])


def code_gold_hits(spark: SparkSession, sf: str) -> DataFrame:
    return measure.lf_table(coded(spark, sf), MESSAGE, "is_gold", "is_code").select("lf", "gold_hits", "code_gold_hits")


def ranked_conjunctions(spark: SparkSession, sf: str) -> DataFrame:
    """Conjunctions on the sample, whose hunks are cut once and written."""
    cut = staged(df_ops.with_hunks(strata(spark, sf)), "sample-hunks")
    size = fx.commits(spark, sf).count()
    return measure.ranked_conjunctions(labeling.apply_lfs(cut, labeling.DIFF), [b for *_, b in labeling.FAMILIES], F.lit(size))


def cwe_of_missed(spark: SparkSession, sf: str) -> DataFrame:
    """CWEs of the gold commits that the majority of message votes doesn't call security."""
    cves_, links_, fixes_ = landed(spark, sf)
    gold = staged(flagged(spark, sf, links_, fixes_).filter("is_cve_fix").select("repo", "sha", "author_date", "is_cve_fix", "cve_id"), "gold")
    # Only gold commits' messages are read.
    asked = fx.commits(spark, sf).join(gold.select("sha").distinct(), "sha", "left_semi")
    voted = staged(labeling.apply_lfs(asked, labeling.MESSAGE).select("sha", combine.majority(list(MESSAGE)).alias("mv_label")), "votes")
    missed = gold.join(voted, "sha").filter("mv_label <> 1")
    return adv.cwe_counts(audit.gold_with_cve(missed, cves_))


def majority_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return fx.vote_matrix(spark, sf).withColumns({"mv_label": combine.majority(VOTES), "n_positive": combine.n_votes(VOTES, 1), "n_negative": combine.n_votes(VOTES, 0)})


def votes_long(spark: SparkSession, sf: str) -> DataFrame:
    long = labeling.long_votes(fx.vote_matrix(spark, sf), VOTES, "l_orderkey", "l_linenumber")
    return long.groupBy("lf", "vote").agg(F.count(F.lit(1)).alias("n"))


def votes_wide(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.wide_votes(labeling.long_votes(fx.vote_matrix(spark, sf), VOTES, "l_orderkey", "l_linenumber"), VOTES, "l_orderkey", "l_linenumber")


def model_labels(spark: SparkSession, sf: str) -> DataFrame:
    votes = fx.vote_matrix(spark, sf)
    model = combine.fit_label_model(combine.patterns(votes, VOTES), VOTES, PRIOR, weight="n")
    return combine.with_labels(votes, model, PRIOR)


def label_model(spark: SparkSession, sf: str) -> DataFrame:
    return model_labels(spark, sf).select("l_orderkey", "l_linenumber", "prob_security", "label", "mv_label")


def lf_accuracies(spark: SparkSession, sf: str) -> DataFrame:
    model = combine.fit_label_model(combine.patterns(fx.vote_matrix(spark, sf), VOTES), VOTES, PRIOR, weight="n")
    return spark.createDataFrame(model.accuracies(), "lf string, accuracy double")


def top_confident(spark: SparkSession, sf: str) -> DataFrame:
    return model_labels(spark, sf).filter("label = 1").orderBy(F.desc("prob_security"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "prob_security").limit(15)


def ablations(spark: SparkSession, sf: str) -> DataFrame:
    """The model on subsets of functions: flagged rows and gold among them."""
    subsets = {"all": VOTES, "positives and one": [*POSITIVE, NEGATIVE[0]], **{f"without {c}": [x for x in VOTES if x != c] for c in POSITIVE}}
    return combine.ablated(fx.vote_matrix(spark, sf), VOTES, subsets, PRIOR, "is_gold")


def given_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The vote matrix with what the given model says of each row."""
    mu = np.zeros((2 * len(VOTES), 2))
    for j, c in enumerate(VOTES):
        own = GIVEN_VOTES[c]  # of security and of other rows, those that it votes on
        mu[2 * j + fx.POLARITY[c]] = own[1], own[0]
    model = combine.LabelModel(VOTES, np.where(mu > 0, mu, 1.0), np.array([1 - GIVEN_PRIOR, GIVEN_PRIOR]))
    return combine.with_labels(fx.vote_matrix(spark, sf), model)


def posterior(spark: SparkSession, sf: str) -> DataFrame:
    return given_labels(spark, sf).select("l_orderkey", "l_linenumber", F.round("prob_security", 9).alias("prob_security"), "label")


def most_likely(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen rows that the given model is surest of."""
    found = given_labels(spark, sf).withColumn("prob_security", F.round("prob_security", 9)).filter("label = 1")
    return found.select("l_orderkey", "l_linenumber", "prob_security").distinct().orderBy(F.desc("prob_security"), "l_orderkey", "l_linenumber").limit(15)


def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    votes = model_labels(spark, sf).withColumn("sha", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return sampling.review_sample(votes, 50).select("sha", "repo", "prob_security", "verdict")


def labelled_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with the label that the model gives their votes (``y``; abstentions go), how sure it is (``weight``), and whether the repository is held out."""
    voted = staged(labeling.apply_lfs(fx.commits(spark, sf), labeling.MESSAGE).select("repo", "sha", "message", *MESSAGE), "votes")
    model = combine.fit_label_model(combine.patterns(voted, list(MESSAGE)), list(MESSAGE), 0.3, weight="n")
    kept = combine.with_labels(voted, model).filter("label <> -1")
    return kept.select("repo", "sha", "message", F.col("label").cast("double").alias("y"), (F.abs(F.col("prob_security") - 0.5) * 2).alias("weight"), (F.pmod(F.xxhash64("repo"), F.lit(4)) == 0).alias("held_out"))


def text_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted text classifier of labels, learned from some repositories and tested on the others: accuracy there, beside the larger label's share."""
    rows = labelled_messages(spark, sf)
    model = text_model.fit(rows.filter(~F.col("held_out")), "message", "y", "weight")
    tested = model.probability(rows.filter("held_out"), "message", "p")
    right = F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double"))
    return tested.agg(F.count(F.lit(1)).alias("tested"), right.alias("accuracy"), F.greatest(F.avg("y"), 1 - F.avg("y")).alias("majority"))


def cves(spark: SparkSession, sf: str) -> DataFrame:
    return adv.nvd_records(fx.advisories(spark, sf))


def landed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Advisories, their links and their fixes, each written once: what follows reads them several times."""
    records = staged(cves(spark, sf), "cves")
    return records, staged(adv.cve_links(records), "cve-links"), staged(adv.fixes_of_cves(fx.osv(spark, sf), records), "cve-fixes")


def links(spark: SparkSession, sf: str) -> DataFrame:
    return adv.cve_links(cves(spark, sf))


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    return adv.fixes_of_cves(fx.osv(spark, sf), cves(spark, sf))


def targets(cves_: DataFrame, links_: DataFrame, fixes_: DataFrame) -> DataFrame:
    return adv.repo_targets(links_, fixes_, cves_.select("cve_id", "published"))


def shown(records: DataFrame) -> DataFrame:
    """Records with their lists joined."""
    return records.withColumns({"cwes": F.array_join("cwes", ","), "reference_urls": F.array_join("reference_urls", " "), "patch_urls": F.array_join("patch_urls", " ")})


def nvd_records(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cves(spark, sf))


def cve_records(spark: SparkSession, sf: str) -> DataFrame:
    r = adv.cve_records(*landed(spark, sf))
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    return r.select("cve_id", F.array_join("github_repos", ",").alias("github_repos"), "primary_repo", n("patch_refs").alias("n_patch_refs"), n("osv_fixes").alias("n_fixes"))


def repo_targets(spark: SparkSession, sf: str) -> DataFrame:
    t = targets(*landed(spark, sf))
    pairs = F.transform(F.array_sort(F.map_entries("commit_to_cve")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return t.select("repo_key", *[F.array_join(c, ",").alias(c) for c in ("cve_ids", "fix_commits", "fix_prs")], F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("commit_to_cve"))


def reference_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return adv.reference_kinds(cves(spark, sf)).select("cve_id", F.array_join("advisory_urls", " ").alias("advisory_urls"), F.array_join("other_urls", " ").alias("other_urls"))


def git_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log records with ten fields (some cut short) and file blocks, parsed and joined again."""
    raw = fx.raw_commits(spark, sf)
    fields = F.concat_ws("\x1f", *[F.col(c) for c in cm.FIELDS])
    log = raw.select("repo", F.concat(F.lit("\n"), F.when(F.col("id") % 37 == 3, F.concat_ws("\x1f", "sha", "parents")).otherwise(fields)).alias("value"))
    lines = F.transform("files", lambda f: F.concat_ws("\t", (F.col("insertions") % 50).cast("string"), (F.col("deletions") % 50).cast("string"), f))
    stats = raw.select("repo", F.concat(F.col("sha"), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("value"))
    out = cm.derived(cm.with_stats(cm.parse_log(log), cm.parse_stats(stats)))
    return out.select("repo", "sha", "author_email", "committer_date", "subject", "message", "is_merge", "n_parents", "n_files", F.array_join("files", ",").alias("files"), "insertions", "deletions")


def named_commits(spark: SparkSession, sf: str) -> DataFrame:
    """What advisories are held against: commits without their texts, written once as several steps read them."""
    return staged(fx.commits(spark, sf).select("repo", "sha", "author_date", "subject"), "named-commits")


def resolved(commits: DataFrame, links_: DataFrame, fixes_: DataFrame) -> DataFrame:
    return cm.resolve_shas(audit.with_commit_reference(links_, fixes_), commits).select("cve_id", "repo_key", "commit", "full_sha")


def flagged(spark: SparkSession, sf: str, links_: DataFrame, fixes_: DataFrame) -> DataFrame:
    """Commits with their own gold flags. What doesn't show a repository's list of CVEs begins here: the list is far longer than a commit."""
    commits = named_commits(spark, sf)
    return cm.flag_fixes(commits, resolved(commits, links_, fixes_))


def lists(links_: DataFrame, fixes_: DataFrame) -> DataFrame:
    """The repositories' lists of CVEs, in pieces."""
    return cm.list_pieces(staged(adv.repo_cves(links_, fixes_), "repo-cves"))


def golden(spark: SparkSession, sf: str) -> DataFrame:
    """Commits with their gold flags and their repositories' CVEs."""
    _, links_, fixes_ = landed(spark, sf)
    return cm.with_repo_lists(staged(flagged(spark, sf, links_, fixes_), "flagged"), lists(links_, fixes_))


def gold_with_cve(spark: SparkSession, sf: str) -> DataFrame:
    cves_, links_, fixes_ = landed(spark, sf)
    return audit.gold_with_cve(flagged(spark, sf, links_, fixes_), cves_)


def unattributed(spark: SparkSession, sf: str) -> DataFrame:
    _, links_, fixes_ = landed(spark, sf)
    own = flagged(spark, sf, links_, fixes_).select("repo", "sha", "is_cve_fix", "cve_id")
    return audit.unattributed(audit.with_commit_reference(links_, fixes_), staged(own, "flagged"))


def window_summary(spark: SparkSession, sf: str) -> DataFrame:
    cves_, links_, fixes_ = landed(spark, sf)
    return adv.window_summary(cves_, links_, targets(cves_, links_, fixes_))


def gold_flags(spark: SparkSession, sf: str) -> DataFrame:
    return golden(spark, sf).select("repo", "sha", "is_cve_fix", "cve_id", F.array_join("cve_ids", ",").alias("all_cves"), "repo_cve_ids")


def control_trips(spark: SparkSession, sf: str) -> DataFrame:
    voted = labeling.apply_lfs(df_ops.with_hunks(strata(spark, sf)), labeling.DIFF)
    both = [b for *_, b in labeling.FAMILIES]
    tripped = measure.control_trips(voted, both, F.lit(1.0))
    size = fx.commits(spark, sf).agg(F.count(F.lit(1)).alias("corpus"))
    return tripped.join(size).select("n", "tripped", "rate", (F.col("rate") * F.col("corpus")).alias("expected"))


def family_table(spark: SparkSession, sf: str) -> DataFrame:
    voted = labeling.apply_lfs(hunks(spark, sf), labeling.DIFF)
    return measure.family_table(voted, labeling.FAMILIES)


def fired_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty commits that one function fired on, drawn by hash."""
    voted = labeling.apply_lfs(fx.commits(spark, sf), labeling.MESSAGE).select("sha", "repo", "subject", "lf_vuln_class")
    return sampling.sample(staged(voted, "votes").filter("lf_vuln_class <> -1").drop("lf_vuln_class"), 20, 5)


def kept_cves(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred CVEs, by date, that name a repository and a patch."""
    found = links(spark, sf).groupBy("cve_id").agg(F.count("kind").alias("n_patch_refs")).filter("n_patch_refs > 0")
    return cves(spark, sf).select("cve_id", "published").join(found, "cve_id").orderBy("published", "cve_id").limit(100)


#: Functions in Python whose twins in columns are known.
PYTHON = [
    labeling.row_function("py_cve_id", 1, ["message"], lambda m: 1 if m and re.search(v.CVE, m, re.IGNORECASE) else None),
    labeling.BatchFunction("py_merge_commit", 0, ("message", "is_merge"), lambda x: np.where(x["is_merge"].fillna(False) & ~x["message"].fillna("").str.contains(v.CVE, case=False), 0, -1)),
    labeling.row_function("py_huge_diff", 0, ["n_files", "insertions", "deletions", "message"], lambda n, i, d, m: 0 if ((n or 0) > 50 or (i or 0) + (d or 0) > 5000) and not re.search(v.CVE, m or "", re.IGNORECASE) else -1),
    labeling.row_function("py_style", 0, ["subject", "message"], lambda s, m: 0 if re.search(v.STYLE, s or "", re.IGNORECASE) and not re.search(v.SECURITY_NOUN, m or "", re.IGNORECASE) else None),
]


def python_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Labeling functions in Python beside the columns that say the same."""
    own = [lf for lf in labeling.MESSAGE if lf.name in ("lf_cve_id", "lf_merge_commit", "lf_huge_diff", "lf_typo_or_style")]
    voted = labeling.apply_lfs(fx.commits(spark, sf), [*PYTHON, *own])
    return voted.select("sha", *[lf.name for lf in (*PYTHON, *own)])


def stored(spark: SparkSession, sf: str) -> CommitStore:
    """The commits in a store by repository, each written twice, as when mined twice; one repository has over a third of them."""
    repo = F.when(F.col("id") % 3 == 0, "org/src0").otherwise(F.col("repo"))
    rows = fx.commits(spark, sf).select(repo.alias("repo"), "sha", "subject", "message", "n_files", "is_gold", "author_date")
    return CommitStore.write(rows.unionByName(rows), buckets=16)


def dump_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Commits written as packed dumps of metadata, files and patches, read back and joined again."""
    commits = staged(fx.raw_commits(spark, sf), "commits")
    log, stats, patches = (new_path(spark, f"dump-{k}") for k in ("log", "stats", "patches"))
    dumps.write_log_dump(commits, log)
    dumps.write_stats_dump(commits, stats)
    dumps.write_patch_dump(commits, patches)
    parsed = cm.derived(cm.with_stats(dumps.read_log_dump(spark, log), cm.parse_stats(dumps.read_stats_dump(spark, stats))))
    whole = parsed.join(dumps.read_patch_dump(spark, patches), ["repo", "sha"])
    return whole.select("repo", "sha", "parents", "author_email", "author_date", "subject", F.md5("body").alias("body"), F.array_join("files", ",").alias("files"), "insertions", "deletions", F.md5("diff_text").alias("patch"))


def target_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The index of repositories, written as nested documents of a few repositories each and read back."""
    path = new_path(spark, "targets")
    tables.write_targets(targets(*landed(spark, sf)), path, 7)
    back = tables.read_targets(spark, path)
    pairs = F.transform(F.array_sort(F.map_entries("commit_to_cve")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return back.select("repo_key", *[F.array_join(c, ",").alias(c) for c in ("cve_ids", "fix_commits", "fix_prs")], F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("commit_to_cve"))


def landed_nvd(spark: SparkSession, sf: str) -> DataFrame:
    """Advisory pages, landed as JSON lines and read with their schema."""
    path = new_path(spark, "nvd")
    fx.advisories(spark, sf).write.json(path)
    return shown(adv.nvd_records(tables.read_nvd_pages(spark, path)))


def landed_osv(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "osv")
    fx.osv(spark, sf).write.json(path)
    return adv.osv_fixes(tables.read_osv(spark, path))


def cve_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Records of which each was written twice, as it was and as it is: the last published stays."""
    path, now = new_path(spark, "cves"), cves(spark, sf)
    before = now.withColumns({"last_modified": F.lit("1990-01-01T00:00:00"), "description": F.lit("as it was"), "cwes": F.array().cast("array<string>")})
    tables.write_rows(now.unionByName(before), path, "json")
    return shown(tables.read_cves(spark, path).drop("github_repos", "primary_repo"))


def reread_commits(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """The commit table with its gold flags, written and read with its schema. Messages are derived after the flags' join, which would move them too."""
    path, named = new_path(spark, "commit-table"), named_commits(spark, sf)
    _, links_, fixes_ = landed(spark, sf)
    whole = cm.derived(cm.flag_fixes(fx.raw_commits(spark, sf).drop("diff_text"), staged(resolved(named, links_, fixes_), "resolved")))
    tables.write_commit_table(whole, lists(links_, fixes_), path, kind)
    back, pieces = tables.read_commit_table(spark, path, kind)
    shown_ = back.select("repo", "sha", "author_date", "subject", "n_files", "is_merge", F.md5("message").alias("message"), F.array_join("files", ",").alias("files"), "is_cve_fix", "cve_id")
    return cm.with_repo_lists(staged(shown_, "reread"), pieces)


def reread_sample(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "patch-sample")
    strata(spark, sf, "sha", "repo", "is_gold", "diff_text").select("sha", "repo", "stratum", F.col("diff_text").alias("diff")).write.parquet(path)
    return tables.read_patch_sample(spark, path).select("sha", "repo", "stratum", F.md5("diff_text").alias("patch"))


def reread_citations(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "citation-table")
    citations(spark, sf).write.parquet(path)
    return tables.read_citations(spark, path, fx.commits(spark, sf).select("sha"))


def label_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Per label of the given model: rows, and the least and greatest probability."""
    p = F.round("prob_security", 9)
    return given_labels(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("least"), F.max(p).alias("most"))


QUERIES: dict[str, Query] = {
    "lf_summary": lf_summary,
    "lf_votes": lf_votes,
    "all_lf_summary": all_lfs,
    "seed_votes": lambda s, d: features.seed_votes(fx.commits(s, d)).select("sha", "seed"),
    "release_window": release_window,
    "release_log": release_log,
    "diff_hunks": lambda s, d: hunks(s, d).select("sha", "diff_added", "diff_removed"),
    "diff_votes": diff_votes,
    "diff_prefilter": lambda s, d: fx.commits(s, d).select("sha", df_ops.prefiltered(F.col("diff_text")).alias("patch")),
    "diff_lines": lambda s, d: df_ops.diff_lines(fx.commits(s, d)),
    "changed_paths": changed_paths,
    "diff_excerpt": lambda s, d: df_ops.excerpt(fx.commits(s, d)),
    "citations": citations,
    "stratified_sample": lambda s, d: strata(s, d, "sha", "is_gold").select("sha", "stratum"),
    "stratum_sizes": lambda s, d: sampling.stratum_sizes(strata(s, d, "sha", "is_gold", "diff_text")),
    "seeded_sample": lambda s, d: sampling.sample(fx.commits(s, d).select("sha", "repo"), 100, 7),
    "control_rates": control_rates,
    "control_trips": control_trips,
    "family_table": family_table,
    "fired_sample": fired_sample,
    "kept_cves": kept_cves,
    "weak_functions": lambda s, d: measure.weak_functions(staged(lf_summary(s, d), "lf-table")),
    "majority_vote": lambda s, d: majority_matrix(s, d).select("l_orderkey", "l_linenumber", "mv_label"),
    "vote_patterns": lambda s, d: combine.patterns(fx.vote_matrix(s, d), VOTES),
    "votes_long": votes_long,
    "votes_wide": votes_wide,
    "vote_table": lambda s, d: measure.lf_table(fx.vote_matrix(s, d), fx.POLARITY, "is_gold"),
    "vote_headline": lambda s, d: measure.headline(majority_matrix(s, d), fx.POLARITY, label="mv_label"),
    "threshold_sweep": lambda s, d: measure.threshold_sweep(given_labels(s, d), CUTS),
    "posterior": posterior,
    "most_likely": most_likely,
    "label_distribution": lambda s, d: measure.label_distribution(majority_matrix(s, d), "mv_label"),
    "gold_recall": lambda s, d: measure.gold_recall(majority_matrix(s, d), "mv_label"),
    "cofire": lambda s, d: measure.cofire(combine.patterns(fx.vote_matrix(s, d), VOTES), POSITIVE),
    "vetoes": lambda s, d: measure.vetoes(majority_matrix(s, d), NEGATIVE),
    "by_repo": lambda s, d: measure.by_repo(majority_matrix(s, d), VOTES),
    "gold_detail": lambda s, d: measure.gold_detail(majority_matrix(s, d), fx.POLARITY, "l_orderkey", "l_linenumber"),
    "conversion": lambda s, d: measure.conversion(majority_matrix(s, d), VOTES, "mv_label"),
    "missed_gold": lambda s, d: measure.missed_gold(majority_matrix(s, d), NEGATIVE, "mv_label"),
    "vote_unions": lambda s, d: measure.unions(fx.vote_matrix(s, d), fx.POLARITY),
    "code_gold_hits": code_gold_hits,
    "code_vetoes": lambda s, d: measure.vetoes(coded(s, d), message_names(0), code="is_code", label="label"),
    "gold_rows": gold_rows,
    "ranked_conjunctions": ranked_conjunctions,
    "fired_on": lambda s, d: measure.fired_on(fx.vote_matrix(s, d), "lf_large"),
    "fired_on_in_repo": lambda s, d: measure.fired_on(fx.vote_matrix(s, d), "lf_large", "org/1"),
    "attached_sample": lambda s, d: sampling.attached(fx.commits(s, d).select("sha", "repo", "n_files"), strata(s, d, "sha", "is_gold").select("sha", "stratum")),
    "label_model": label_model,
    "lf_accuracies": lf_accuracies,
    "top_confident": top_confident,
    "ablations": ablations,
    "review_sample": review_sample,
    "text_classifier": text_classifier,
    "url_parse": links,
    "nvd_records": nvd_records,
    "advisory_window": lambda s, d: adv.in_window(cves(s, d), "1996-08-31 00:00:00", 18, 2.5).select("cve_id", "published", "cvss_score"),
    "primary_repo": lambda s, d: adv.primary_repos(links(s, d)),
    "osv_fixes": lambda s, d: adv.osv_fixes(fx.osv(s, d)),
    "cve_fixes": fixes,
    "cve_records": cve_records,
    "repo_targets": repo_targets,
    "ranked_targets": lambda s, d: adv.ranked_targets(targets(*landed(s, d)), 2, 25),
    "window_summary": window_summary,
    "cwe_counts": lambda s, d: adv.cwe_counts(cves(s, d)),
    "reference_kinds": reference_kinds,
    "git_log": git_log,
    "history_window": lambda s, d: cm.history_window(fx.commits(s, d), since="2024-01-01T06:00:00", until="2025-01-01T00:00:00", newest=20).select("repo", "sha"),
    "resolve_shas": lambda s, d: resolved(named_commits(s, d), *landed(s, d)[1:]),
    "gold_flags": gold_flags,
    "distinct_commits": lambda s, d: cm.distinct_commits(fx.commits(s, d).select("repo", "sha")),
    "repo_counts": lambda s, d: cm.repo_counts(flagged(s, d, *landed(s, d)[1:])),
    "backports": lambda s, d: cm.collapse_backports(fx.commits(s, d)),
    "backport_members": lambda s, d: cm.backport_members(fx.commits(s, d).select("repo", "sha", "subject", "author_date")),
    "python_votes": python_votes,
    "repo_view": lambda s, d: stored(s, d).view("org/src1").select("repo", "sha", "subject", "n_files", "is_gold"),
    "hot_repo_view": lambda s, d: stored(s, d).view("org/src0").select("repo", "sha", "subject", "n_files", "is_gold"),
    "stored_distinct": lambda s, d: stored(s, d).distinct().select("repo", "sha"),
    "stored_counts": lambda s, d: stored(s, d).counts("is_gold"),
    "dump_round_trip": dump_round_trip,
    "target_parts": target_parts,
    "label_extremes": label_extremes,
    "landed_nvd": landed_nvd,
    "landed_osv": landed_osv,
    "cve_lines": cve_lines,
    "commits_parquet": lambda s, d: reread_commits(s, d, "parquet"),
    "commits_json": lambda s, d: reread_commits(s, d, "json"),
    "reread_sample": reread_sample,
    "reread_citations": reread_citations,
    "gold_audit": lambda s, d: audit.cve_index(gold_with_cve(s, d)),
    "unattributed_cves": unattributed,
    "flat_gold": lambda s, d: audit.flat_gold(flagged(s, d, *landed(s, d)[1:])),
    "cwe_of_gold": lambda s, d: adv.cwe_counts(gold_with_cve(s, d)),
    "cwe_of_missed": cwe_of_missed,
}
