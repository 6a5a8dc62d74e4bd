"""Layouts on disk: commits by repository, packed dumps, the index of targets in parts."""

import random

import pytest
from pyspark.sql import functions as F

from patchlight.jobs import queries as q
from patchlight.operators import commits as cm
from patchlight.sources import commit_store, dumps, schemas, tables
from patchlight.sources.commit_store import CommitStore


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark):
    rows = [("big", f"s{k % 300}", k % 7 == 0) for k in range(600)] + [(f"r{k % 40}", f"s{k}", None) for k in range(400)] + [(None, "s1", True), (None, "s1", True), ("r1", None, False)]
    made = CommitStore.write(spark.createDataFrame(rows, "repo string, sha string, is_gold boolean"), buckets=8)
    yield made, rows
    made.drop()


def test_a_repository_is_read_from_one_bucket(store):
    made, rows = store
    assert made.hot_repos == ("big",)
    for repo in ("r3", "big", "absent"):
        view = made.view(repo)
        assert sorted(map(str, view.collect())) == sorted(str(r) for r in made.rows().filter(F.col("repo") == repo).collect())
        assert len(view.collect()) == sum(r[0] == repo for r in rows)
        text = plan(view)
        assert "Exchange" not in text
        name = "repo" if repo == "big" else "repo_bucket"
        filters = next(line for line in text.split("\n") if "PartitionFilters" in line).split("PartitionFilters: [")[1].split("]")[0]
        assert f"{name}#" in filters


def test_counts_and_duplicates_need_no_shuffle(spark, store):
    made, rows = store
    assert made.distinct().count() == len({r[:2] for r in rows})
    text = plan(made.distinct())
    assert "Exchange" not in text and "HashAggregate" in text or "SortAggregate" in text
    got = {r["repo"]: (r["commits"], r["gold"]) for r in made.counts("is_gold").collect()}
    assert got == {repo: (sum(r[0] == repo for r in rows), sum(r[0] == repo and bool(r[2]) for r in rows)) for repo in {r[0] for r in rows}}
    cold = spark.table(made.cold).groupBy("repo").count()
    assert "Exchange" not in plan(cold)


def test_an_empty_store(spark):
    made = CommitStore.write(spark.createDataFrame([], "repo string, sha string, is_gold boolean"), buckets=4)
    assert made.rows().count() == made.distinct().count() == made.counts("is_gold").count() == made.view("x").count() == 0
    made.drop()


def test_dumps_give_every_value_back(spark, tmp_path):
    odd = ["plain", "", None, "a\x1fb", "\x1e", "\x10N", "\x10", "\x10R\x1e\x1f\x10", "line\r\nline\n", "\u00e9\U0001f600\u2028", "x" * 70_000]
    rng = random.Random(1)
    rows = [(f"o/{k % 5}", f"s{k}", rng.choice(odd), rng.choice(odd)) for k in range(300)]
    made = spark.createDataFrame(rows, "repo string, sha string, body string, diff_text string").repartition(3)
    path = str(tmp_path / "dump")
    dumps.write_dump(made, ["repo", "sha", "body", "diff_text"], path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
        back = dumps.read_dump(spark, path, ["repo", "sha", "body", "diff_text"])
        assert back.rdd.getNumPartitions() > 3  # a file is many tasks'
        assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert dumps.read_dump(spark, path, ["repo", "sha", "body", "diff_text", "more"]).count() == 0


def test_log_and_stats_dumps_are_parsed(spark, tmp_path):
    row = ("o/r", "s1", "p1 p2", "An", "a@x", "2024-01-01", "C", "c@x", "2024-01-02", "Sub\x1fject", "Body\nmore", ["a b.py", "c.c"], 7, 3)
    bare = ("o/r", "s2", "", "An", "a@x", "2024-01-01", "C", "c@x", "2024-01-02", "", None, None, None, None)
    made = spark.createDataFrame([row, bare], "repo string, " + ", ".join(f"{c} string" for c in cm.FIELDS) + ", files array<string>, insertions int, deletions int")
    dumps.write_log_dump(made, str(tmp_path / "log"))
    dumps.write_stats_dump(made, str(tmp_path / "stats"))
    out = cm.derived(cm.with_stats(dumps.read_log_dump(spark, str(tmp_path / "log")), cm.parse_stats(dumps.read_stats_dump(spark, str(tmp_path / "stats")))))
    got = {r["sha"]: r for r in out.collect()}
    assert got["s1"]["files"] == ["a b.py", "c.c"] and (got["s1"]["insertions"], got["s1"]["deletions"]) == (7, 3)
    assert got["s1"]["subject"] == "Sub\x1fject" and got["s1"]["message"] == "Sub\x1fject\n\nBody\nmore" and got["s1"]["is_merge"]
    assert got["s2"]["files"] == [] and got["s2"]["insertions"] == 0 and got["s2"]["n_parents"] == 0


def test_targets_are_written_in_parts(spark, tmp_path):
    rows = [(f"o/r{k}", [f"CVE-{k}"], [f"c{k}"], [], {f"c{k}": f"CVE-{k}"}) for k in range(50)]
    made = spark.createDataFrame(rows, "repo_key string, cve_ids array<string>, fix_commits array<string>, fix_prs array<string>, commit_to_cve map<string,string>")
    tables.write_targets(made, str(tmp_path / "t"), 4)
    assert spark.read.text(str(tmp_path / "t")).count() > 5
    assert sorted(r["repo_key"] for r in tables.read_targets(spark, str(tmp_path / "t")).collect()) == sorted(r[0] for r in rows)
    (tmp_path / "one.json").write_text('{"targets": [\n {"repo_key": "o/r", "cve_ids": ["C"], "fix_commits": [], "fix_prs": ["1"], "commit_to_cve": {}}\n]}')
    assert [r["fix_prs"] for r in tables.read_targets(spark, str(tmp_path / "one.json"), whole=True).collect()] == [["1"]]
    tables.write_targets(made.limit(0), str(tmp_path / "none"))
    assert tables.read_targets(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [1, 3, 10, 1000])
def test_the_newest_are_those_of_a_plain_sort(spark, n):
    rng = random.Random(n)
    days = ["2024-01-01T00:00:00", "2024-01-01T05:00:00", "2024-01-02T00:00:00", None]
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"s{k:03}", rng.choice(days)) for k in range(200)] + [("c", "s1", None)]
    made = spark.createDataFrame(rows, "repo string, sha string, at string")
    got = cm.newest_of(made, "repo", F.to_timestamp("at"), "sha", n)
    want = []
    for repo in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == repo), key=lambda r: r[1])
        want += sorted(own, key=lambda r: r[2] or "", reverse=True)[:n]
    assert got.columns == made.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_backports_have_members_and_a_first(spark):
    rows = [("o/r", "fix", "s2", "2024-01-01"), ("o/r", "fix", "s1", "2024-01-01"), ("o/r", "fix", "s0", "2024-01-02"), ("o/r", None, "s4", "2024"), ("o/x", "fix", "s5", "2024")]
    made = spark.createDataFrame(rows, "repo string, subject string, sha string, author_date string")
    assert {(r["repo"], r["subject"], r["n"], r["representative"]) for r in cm.collapse_backports(made).collect()} == {("o/r", "fix", 3, "s1"), ("o/r", None, 1, "s4"), ("o/x", "fix", 1, "s5")}
    assert {(r["sha"], r["representative"]) for r in cm.backport_members(made).collect()} == {("s0", "s1"), ("s1", "s1"), ("s2", "s1"), ("s4", "s4"), ("s5", "s5")}


def test_backports_name_all_their_commits(spark):
    rows = [("o/r", "fix", "s2", "2024"), ("o/r", "fix", "s1", "2024"), ("o/r", "fix", "s2", "2023"), ("o/x", None, "s5", "2024")]
    made = cm.collapse_backports(spark.createDataFrame(rows, "repo string, subject string, sha string, author_date string"))
    assert {(r["repo"], r["n"], r["shas"]) for r in made.collect()} == {("o/r", 3, "s1,s2"), ("o/x", 1, "s5")}


def test_a_repositorys_list_is_stored_once_and_dealt_out(spark, tmp_path, monkeypatch):
    """A list of CVEs isn't stored with each commit, and a repository's commits aren't one task's when they get it."""
    monkeypatch.setattr(cm, "LIST_ROWS", 50)
    columns = [f"'{c}' AS {c}" if kind == "string" else f"cast(NULL AS {kind}) AS {c}" for c, kind in (x.split(" ") for x in schemas.COMMITS.split(", ")) if c not in ("sha", "repo", "repo_cve_ids")]
    made = spark.range(603).selectExpr("cast(id AS string) AS sha", "CASE WHEN id < 600 THEN 'O/Big' WHEN id < 602 THEN 'o/small' END AS repo", *columns)
    long = ",".join(f"CVE-{k}" for k in range(5000))
    lists = spark.createDataFrame([("o/big", long), ("o/other", "x")], "repo_key string, repo_cve_ids string")
    for kind in ("parquet", "json"):
        path = tmp_path / kind
        tables.write_commit_table(made, lists, str(path), kind)
        assert sum(f.stat().st_size for f in path.rglob("*.json")) < 20 * len(long)
        back, again = tables.read_commit_table(spark, str(path), kind)
        out = cm.with_repo_lists(back.select("repo", "sha"), again)
        got = [(r["repo"], r["sha"], r["repo_cve_ids"]) for r in out.collect()]
        assert sorted(map(str, got)) == sorted(str((repo, str(k), long if k < 600 else "")) for k in range(603) for repo in ("O/Big" if k < 600 else "o/small" if k < 602 else None,))
        held = out.filter("repo = 'O/Big'").groupBy(F.spark_partition_id()).count().collect()
        assert len(held) >= 4 and max(r["count"] for r in held) < 400


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_the_lists_are_stored_in_pieces(spark, monkeypatch, kind):
    """No row holds a list of any length, and pieces meet in their order."""
    monkeypatch.setattr(cm, "LIST_PIECE", 5, raising=False)
    monkeypatch.setattr(cm, "RANGE_ROWS", 100, raising=False)
    read, sizes = tables.read_commit_table, []

    def watched(*args):
        back, lists = read(*args)
        sizes.extend(r[0] for r in lists.select(F.size(F.split("repo_cve_ids", ","))).collect())
        return back, lists

    monkeypatch.setattr(tables, "read_commit_table", watched)
    got = {r["repo"].lower(): r["repo_cve_ids"] for r in q.reread_commits(spark, "/root/testdata/sf0.01", kind).collect()}
    want = {r["repo_key"]: r["cve_ids"] for r in q.targets(*q.landed(spark, "/root/testdata/sf0.01")).collect()}
    assert max(sizes) == 5 and sum(sizes) == sum(map(len, want.values())) and max(map(len, want.values())) > 50
    assert got == {repo: ",".join(want.get(repo, [])) for repo in got} and any(got.values())


@pytest.mark.parametrize("name", ["unattributed_cves", "repo_counts", "gold_audit", "flat_gold", "cwe_of_gold"])
def test_only_what_shows_a_repositorys_list_makes_it(spark, monkeypatch, name):
    """Each commit would carry (and, where flags are written, store) its repository's whole list of CVEs."""

    def refused(*_):
        raise AssertionError("lists are made")

    monkeypatch.setattr(cm, "with_repo_lists", refused)
    q.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_more_rows_make_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(commit_store, "BUCKET_ROWS", 100)
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'big' ELSE concat('r', id % 500) END AS repo", "cast(id % 1700 AS string) AS sha", "id % 5 = 0 AS is_gold")
    made = CommitStore.write(rows, buckets=2)
    assert made.buckets == 30 and made.hot_repos == ("big",)
    held = made.rows().groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in held) < 500
    assert sorted(map(str, made.rows().collect())) == sorted(map(str, rows.collect()))
    assert made.distinct().count() == rows.select("repo", "sha").distinct().count()
    assert made.view("r7").count() == rows.filter("repo = 'r7'").count()
    made.drop()
