import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlight.operators import advisories as adv
from patchlight.operators import combine, measure, sampling
from patchlight.operators import commits as cm
from patchlight.sources import tables

URLS = [
    ("https://github.com/Org/Repo/commit/ABCDEF1", ("org/repo", "commit", "abcdef1")),
    ("https://github.com/org/repo/commit/abcde", ("org/repo", None, None)),
    ("https://github.com/org/repo/commits/" + "a" * 41, ("org/repo", None, None)),
    ("https://WWW.github.com/o/r.git", ("o/r", None, None)),
    ("https://github.com/o/r).,", ("o/r", None, None)),
    ("https://github.com/o/r/pull/12/files", ("o/r", "pull", "12")),
    ("https://github.com/o/r/pull/x", ("o/r", None, None)),
    ("https://github.com/o/r/compare/a...b", ("o/r", "compare", "a...b")),
    ("https://github.com/o/r/releases/tag/v1", ("o/r", "release", "v1")),
    ("https://github.com/o/r/releases/tag", ("o/r", None, None)),
    ("https://api.github.com/repos/o/r/commits/abcdef1", ("o/r", "commit", "abcdef1")),
    ("https://api.github.com/o/r", None),
    ("https://github.com:443/o/r", None),
    ("https://user@github.com/o/r", None),
    ("https://github.com/ADVISORIES/x", None),
    ("https://github.com/o", None),
    ("https://gitlab.com/o/r", None),
    ("https://github.com/o/r/commit/abcdef1;x=1;y", ("o/r", "commit", "abcdef1")),
    ("https://github.com/o;a/r/pull/7;z", ("o;a/r", "pull", "7")),
    ("nothing", None),
    (None, None),
]


def test_links(spark):
    rows = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(URLS)], "k int, u string").select("k", adv.parse_link(F.col("u")).alias("x")).collect()
    for r in rows:
        x = r["x"]
        assert (x and (x["repo_key"], x["kind"], x["id"])) == URLS[r["k"]][1], URLS[r["k"]]


def test_primary_repository(spark):
    links = [("c1", 0, "a/a", None), ("c1", 1, "b/b", "commit"), ("c1", 2, "c/c", "pull"), ("c1", 3, "c/c", "compare"), ("c2", 0, "a/a", None), ("c3", 0, "a/a", None), ("c3", 1, "b/b", None), ("c4", 5, "z/z", "commit"), ("c4", 7, "a/a", "commit")]
    rows = spark.createDataFrame([(*r, r[2][0], r[2][2]) for r in links], "cve_id string, pos int, repo_key string, kind string, owner string, name string")
    assert {r["cve_id"]: r["primary_repo"] for r in adv.primary_repos(rows).collect()} == {"c1": "c/c", "c2": "a/a", "c3": None, "c4": "z/z"}


def test_log_and_stats(spark):
    fields = ["s1", "p1 p2", "An", "a@x", "2024-01-01T00:00:00+00:00", "C", "c@x", "2024-01-02T00:00:00+00:00", "Subject", "Body\r\nmore\n"]
    log = spark.createDataFrame([("o/r", "\n" + "\x1f".join(fields)), ("o/r", "short\x1frecord")], "repo string, value string")
    stats = spark.createDataFrame([("o/r", "s1\n\n12\t3\ta b.py\n-\t-\timg.png\nR100\told\tnew\nM\tz\n")], "repo string, value string")
    r = cm.derived(cm.with_stats(cm.parse_log(log), cm.parse_stats(stats))).collect()
    assert len(r) == 1 and r[0]["files"] == ["a b.py", "img.png", "new", "z"] and (r[0]["insertions"], r[0]["deletions"]) == (12, 3)
    assert r[0]["is_merge"] and r[0]["n_files"] == 4 and r[0]["message"] == "Subject\n\nBody\r\nmore"


def test_short_shas_resolve_only_if_one_commit_begins_so(spark):
    commits = spark.createDataFrame([("abcdef1" + "0" * 33, "O/R"), ("abcdef2" + "1" * 33, "o/r"), ("abcdef2" + "2" * 33, "o/r")], "sha string, repo string")
    refs = spark.createDataFrame([("o/r", c) for c in ("abcdef1", "abcdef2", "abcdef21", "1234567")], "repo_key string, commit string")
    got = {r["commit"]: r["full_sha"] for r in cm.resolve_shas(refs, commits).collect()}
    assert got == {"abcdef1": "abcdef1" + "0" * 33, "abcdef2": "abcdef2", "abcdef21": "abcdef2" + "1" * 33, "1234567": "1234567"}


def test_a_commit_that_fixes_several_keeps_them_all(spark):
    commits = spark.createDataFrame([("s1", "O/R"), ("s2", "o/x")], "sha string, repo string")
    fixes = spark.createDataFrame([("o/r", "S1", "c2"), ("o/r", "s1", "c1")], "repo_key string, full_sha string, cve_id string")
    repos = spark.createDataFrame([("o/r", ["c1", "c2", "c3"])], "repo_key string, cve_ids array<string>")
    got = {r["sha"]: (r["is_cve_fix"], r["cve_id"], r["cve_ids"], r["repo_cve_ids"]) for r in cm.flag_gold(commits, fixes, repos).collect()}
    assert got == {"s1": (True, "c1", ["c1", "c2"], "c1,c2,c3"), "s2": (False, None, [], "")}


def test_wilson_and_headline_shapes(spark):
    low, high = spark.createDataFrame([(38, 40)], "k int, n int").select(*[c.alias(x) for c, x in zip(measure.wilson(F.col("k"), F.col("n")), "ab", strict=True)]).first()
    assert abs(low - 0.835) < 1e-3 and abs(high - 0.986) < 1e-3


def made_votes(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    right = {"a": 0.95, "b": 0.85, "c": 0.7, "d": 0.9}
    rows = {"y": y.astype(int)}
    for k, p in right.items():
        vote = np.where(rng.random(n) < p, y, ~y).astype(int)
        rows[k] = np.where(rng.random(n) < 0.6, vote, -1)
    return spark.createDataFrame([tuple(int(x) for x in r) for r in zip(*rows.values(), strict=True)], ", ".join(f"{k} int" for k in rows)), right


def test_label_model_finds_the_better_functions_and_the_class(spark):
    votes, right = made_votes(spark)
    lfs = list(right)
    model = combine.fit_label_model(votes, lfs, 0.3)
    by_patterns = combine.fit_label_model(combine.patterns(votes, lfs), lfs, 0.3, weight="n")
    assert np.allclose(model.mu, by_patterns.mu)
    found = dict(model.accuracies())
    assert min(found["a"], found["d"]) > found["c"]
    scored = combine.with_labels(votes, model)
    agree = scored.filter("label <> -1").agg(F.avg((F.col("label") == F.col("y")).cast("double"))).first()[0]
    assert agree > 0.85
    none = scored.filter("a = -1 and b = -1 and c = -1 and d = -1").first()
    assert none["label"] == -1 and abs(none["prob_security"] - 0.3) < 1e-9
    # The column arithmetic is naive Bayes on the fitted parameters.
    r = scored.filter("a = 1 and b = 0 and c = -1 and d = 1").first()
    odds = np.log(0.3 / 0.7) + sum(np.log(model.mu[i, 1] / model.mu[i, 0]) for i in (1, 2, 7))
    assert abs(r["prob_security"] - 1 / (1 + np.exp(-odds))) < 1e-9


def test_majority_is_symmetric_and_measures_are_ordered(spark):
    votes, right = made_votes(spark, 500)
    lfs = list(right)
    swapped = votes.select(*[F.when(F.col(c) == -1, -1).otherwise(1 - F.col(c)).alias(c) for c in lfs])
    count = lambda d: {r["m"]: r["n"] for r in d.select(combine.majority(lfs).alias("m")).groupBy("m").agg(F.count("*").alias("n")).collect()}
    a, b = count(votes), count(swapped)
    assert a[1] == b[0] and a[0] == b[1] and a[-1] == b[-1]
    table = measure.lf_table(votes, {c: 1 for c in lfs}).collect()
    assert all(r["coverage"] >= r["overlaps"] >= r["conflicts"] for r in table)
    assert measure.lf_table(votes.limit(0), {c: 1 for c in lfs}).count() == 4


def test_round_trips(spark, tmp_path):
    commits = spark.createDataFrame([("s1", "o/r", ["a", "b"])], "sha string, repo string, files array<string>")
    for kind in ("parquet", "json"):
        tables.write_rows(commits, str(tmp_path / kind), kind)
        assert tables.read_commits(spark, str(tmp_path / kind), kind).first()["files"] == ["a", "b"]
    targets = spark.createDataFrame([("o/r", ["c1"], ["s1"], [], {"s1": "c1"})], "repo_key string, cve_ids array<string>, fix_commits array<string>, fix_prs array<string>, commit_to_cve map<string,string>")
    tables.write_targets(targets, str(tmp_path / "targets"))
    assert tables.read_targets(spark, str(tmp_path / "targets")).first()["commit_to_cve"] == {"s1": "c1"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/abcdef1234.patch").write_text("diff --git a/x b/x\n+y\n")
    assert tables.read_patches(spark, str(tmp_path / "p")).collect()[0].asDict() == {"sha": "abcdef1234", "diff_text": "diff --git a/x b/x\n+y\n"}
    (tmp_path / "log").write_text("a\x1fb\x1e\nc\x1fd\x1e\n")
    assert tables.read_log_records(spark, str(tmp_path / "log")).count() == 2
    absent = tables.read_citations(spark, None, commits).first()
    assert not absent["patch_cites_advisory"] and not absent["patch_cites_fix_commit"]
    (tmp_path / "cves.json").write_text('{"cve_id":"c1","last_modified":"1","description":"old"}\n{"cve_id":"c1","last_modified":"2","description":"new"}\n')
    assert [r["description"] for r in tables.read_cves(spark, str(tmp_path / "cves.json")).collect()] == ["new"]
    tables.write_review(commits.select("sha", F.lit("").alias("verdict")), str(tmp_path / "review"))
    assert (next((tmp_path / "review").glob("*.csv"))).read_text().startswith("sha,verdict")


def test_patch_samples_and_citations_are_read(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "o/r", "gold", "diff --git a/x b/x\n+y")], "sha string, repo string, stratum string, diff string")
    tables.write_rows(rows, str(tmp_path / "sample"))
    assert tables.read_patch_sample(spark, str(tmp_path / "sample")).first()["diff_text"] == "diff --git a/x b/x\n+y"
    cited = spark.createDataFrame([("s1", True, False)], "sha string, patch_cites_advisory boolean, patch_cites_fix_commit boolean")
    tables.write_rows(cited, str(tmp_path / "cited"))
    got = {r["sha"]: (r["patch_cites_advisory"], r["patch_cites_fix_commit"]) for r in tables.read_citations(spark, str(tmp_path / "cited"), spark.createDataFrame([("s1",), ("s2",)], "sha string")).collect()}
    assert got == {"s1": (True, False), "s2": (False, False)}


def test_a_sampled_row_that_is_missing_fails(spark):
    rows = spark.createDataFrame([("s1", 1), ("s2", 2)], "sha string, n int")
    drawn = spark.createDataFrame([("s2", "gold")], "sha string, stratum string")
    assert [tuple(r) for r in sampling.attached(rows, drawn).collect()] == [("s2", "gold", 2)]
    with pytest.raises(Exception, match="not in the table: s3"):
        sampling.attached(rows, drawn.unionByName(spark.createDataFrame([("s3", "gold")], drawn.schema))).collect()


def test_landed_advisories_are_read(spark, tmp_path):
    page = {
        "totalResults": 1,
        "vulnerabilities": [
            {
                "cve": {
                    "id": "CVE-2024-1111",
                    "published": "2024-01-02T00:00:00.000",
                    "lastModified": "2024-01-03T00:00:00.000",
                    "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": "hello"}],
                    "metrics": {"cvssMetricV31": [{"type": "Secondary", "cvssData": {"baseScore": 1.0, "baseSeverity": "LOW"}}, {"type": "Primary", "cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}], "cvssMetricV2": [{"type": "Primary", "baseSeverity": "LOW", "cvssData": {"baseScore": 2.0}}]},
                    "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-Other"}]}, {"description": [{"lang": "en", "value": "CWE-22"}]}],
                    "references": [{"url": "https://github.com/O/R/commit/abcdef1", "tags": ["Patch"]}, {"url": "https://x.example/a"}],
                }
            }
        ],
    }
    (tmp_path / "nvd.json").write_text(json.dumps(page))
    (r,) = adv.nvd_records(tables.read_nvd_pages(spark, str(tmp_path / "nvd.json"))).collect()
    assert (r["cve_id"], r["description"], r["cvss_score"], r["cvss_severity"], r["cwes"]) == ("CVE-2024-1111", "hello", 9.8, "CRITICAL", ["CWE-22", "CWE-79"])
    assert len(r["reference_urls"]) == 2 and r["patch_urls"] == ["https://github.com/O/R/commit/abcdef1"]
    advisory = {
        "id": "GHSA-1",
        "aliases": ["CVE-2024-1111"],
        "affected": [{"ranges": [{"type": "GIT", "repo": "https://github.com/o/r", "events": [{"introduced": "0"}, {"fixed": "ABCDEF12"}]}, {"type": "SEMVER", "events": [{"fixed": "1.2"}]}]}],
        "references": [{"type": "FIX", "url": "https://github.com/o/r/commit/1234567"}, {"type": "WEB", "url": "https://github.com/o/r/commit/7654321"}],
    }
    (tmp_path / "osv.json").write_text(json.dumps(advisory))
    got = {tuple(x) for x in adv.osv_fixes(tables.read_osv(spark, str(tmp_path / "osv.json"))).collect()}
    assert got == {("GHSA-1", "o/r", "abcdef12", "range"), ("GHSA-1", "o/r", "1234567", "reference")}


def test_conjunctions_are_ranked_by_their_control_rate(spark):
    rows = [("control", -1, 1)] * 99 + [("control", 1, -1)] + [("gold", 1, 1), ("gold", 1, -1)]
    got = measure.ranked_conjunctions(spark.createDataFrame(rows, "stratum string, a int, b int"), ["a", "b"], F.lit(1000)).collect()
    assert [tuple(r) for r in got] == [(1, "a", 2, 1, 0.01, 10, "loose"), (2, "b", 1, 99, 0.99, 990, "too loose")]


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
