from pyspark.sql import functions as F

from patchlight.functions.text import increased
from patchlight.operators import labeling


def test_second_text_is_read_only_where_the_first_has_the_pattern(spark):
    rows = [("ab ab", "ab"), ("ab", "ab"), ("", "ab ab"), ("AB ab", ""), (None, "ab")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, r string").select(increased(F.col("a"), F.col("r"), "ab")).collect()]
    assert [bool(x) for x in got] == [True, False, False, True, False]
    # The second text fails if it is read at all.
    none = spark.createDataFrame([("nothing",)], "a string").select(increased(F.col("a"), F.raise_error(F.lit("read")).cast("string"), "ab").alias("x"))
    assert [r[0] for r in none.collect()] == [False]


def test_excuses_are_sought_only_for_touched_surfaces(spark):
    rows = [("Fix CVE-2024-12345", "x.innerHTML = y", ""), ("Tidy", "x.innerHTML = y", ""), ("Fix CVE-2024-12345", "plain", "")]
    commits = spark.createDataFrame([(*r, ["a.js"]) for r in rows], "message string, diff_added string, diff_removed string, files array<string>").withColumns({"subject": F.lit(""), "author_email": F.lit(""), "author_name": F.lit(""), "is_merge": F.lit(False)})
    facts = labeling.diff_facts(labeling.message_facts(commits))
    assert [(r["fact_xss"], r["fact_excused"]) for r in facts.collect()] == [(True, True), (True, False), (False, False)]
    votes = labeling.apply_lfs(commits, labeling.DIFF).collect()
    assert [r["lf_diff_dom_sink_touched"] for r in votes] == [-1, 0, -1]


def test_commits_with_facts_vote_without_their_messages(spark):
    rows = [("Fix CVE-2024-12345", ["a.c"]), ("  x  ", []), ("Prevent path traversal", ["docs/a.md"])]
    commits = spark.createDataFrame(rows, "message string, files array<string>").withColumns({"subject": F.col("message"), "author_email": F.lit(""), "author_name": F.lit(""), "is_merge": F.lit(False), "n_files": F.lit(1), "insertions": F.lit(1), "deletions": F.lit(1)})
    names = [lf.name for lf in labeling.MESSAGE]
    facts = labeling.message_facts(commits).drop("message", "fact_m", "fact_low", "fact_s")
    assert labeling.apply_lfs(facts, labeling.MESSAGE).select(*names).collect() == labeling.apply_lfs(commits, labeling.MESSAGE).select(*names).collect()
