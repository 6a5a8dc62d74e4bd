import random
import re

import pytest
from pyspark.sql import functions as F

from patchlight.operators import labeling
from patchlight.operators.diffs import changed_paths, prefiltered, with_hunks
from patchlight.operators.features import citation_features, release_windows, with_features
from patchlight.operators.labeling import ALL, ALL_WITH_DIFF, DIFF, MESSAGE, BatchFunction, LabelingFunction, apply_lfs, row_function

COLUMNS = "sha string, message string, subject string, files array<string>, n_files int, insertions int, deletions int, is_merge boolean, author_name string, author_email string"


def commit(message, subject=None, files=("a.py",), n_files=None, insertions=0, deletions=0, merge=False, name="Dev", email="dev@x.example"):
    files = None if files is None else list(files)
    return (message, subject if subject is not None else (message or "").split("\n")[0], files, len(files or []) if n_files is None else n_files, insertions, deletions, merge, name, email)


CASES = [
    ("lf_cve_id", 1, commit("see cve-2024-1234")),
    ("lf_cve_id", -1, commit("see CVE-24-1")),
    ("lf_cve_id", -1, commit(None)),
    ("lf_ghsa_id", 1, commit("Fixed GHSA-xrqc-p465-2xvg")),
    ("lf_cwe_id", 1, commit("closes CWE-79")),
    ("lf_vuln_class", 1, commit("Fix OOB read in ISOAL")),
    ("lf_vuln_class", 1, commit("stack overflow in parser")),
    ("lf_vuln_class", -1, commit("a stack overflow  question")),
    ("lf_fix_plus_security_noun", 1, commit("fix: security issue playlist deletion")),
    ("lf_fix_plus_security_noun", -1, commit("fix the build")),
    ("lf_advisory_language", 1, commit("x\n\nThis was discovered by someone")),
    ("lf_advisory_language", -1, commit("Reported with fix by someone")),
    ("lf_security_backport", 1, commit("Backport the Security change")),
    ("lf_security_backport", -1, commit("Backport the change")),
    ("lf_security_paths_and_fix", 1, commit("fix it", files=["x/a.py", "y/b.py", "z/authenticated.cr"])),
    ("lf_security_paths_and_fix", -1, commit("fix it", files=["a", "b", "c", "login.py"])),
    ("lf_security_paths_and_fix", -1, commit("fix it", files=None)),
    ("lf_security_note_path", 1, commit("m", files=["News/Security/a.rst", "Lib/tarfile.py"])),
    ("lf_security_note_path", -1, commit("m", files=["doc/security/a.rst"])),
    ("lf_bounds_check_in_parser", 1, commit("add a length check", files=["parse.c", "b", "c", "d"])),
    ("lf_bounds_check_in_parser", -1, commit("add a length check", files=["parse.c", "b", "c", "d", "e"])),
    ("lf_crash_on_untrusted_input", 1, commit("crash on crafted file")),
    ("lf_docs_only", 0, commit("m", files=["docs/a.py", "README", "b.MD"])),
    ("lf_docs_only", -1, commit("m", files=["a.d/notes"])),
    ("lf_docs_only", -1, commit("m", files=[])),
    ("lf_tests_only", 0, commit("m", files=["tests/a.py", "src/x_test.go"])),
    ("lf_ci_only", 0, commit("m", files=[".github/workflows/a.yml"])),
    ("lf_merge_commit", 0, commit("Merge b", merge=True)),
    ("lf_merge_commit", -1, commit("Merge CVE-2024-1234", merge=True)),
    ("lf_bot_author", 0, commit("m", name="x[bot]")),
    ("lf_version_bump", 0, commit("chore(main): release 0.2.3 (#29)")),
    ("lf_version_bump", -1, commit("release: Zephyr 4.4.0")),
    ("lf_typo_or_style", 0, commit("fix typo")),
    ("lf_typo_or_style", -1, commit("fix typo in unsafe code")),
    ("lf_feature_commit", 0, commit(" feat(x)!: y")),
    ("lf_feature_commit", -1, commit("feat: guard against spoofing")),
    ("lf_huge_diff", 0, commit("m", n_files=51)),
    ("lf_huge_diff", -1, commit("m", n_files=50, insertions=4000, deletions=1000)),
    ("lf_huge_diff", 0, commit("m", insertions=5001)),
    ("lf_empty_message", 0, commit(" 1234567 \n", files=[])),
    ("lf_empty_message", -1, commit("12345678", files=[])),
    ("lf_tests_only", -1, commit("École tests", files=["src/École.py"])),
]


def test_message_functions(spark):
    rows = [(str(k), *c) for k, (_, _, c) in enumerate(CASES)]
    got = {r["sha"]: r for r in apply_lfs(spark.createDataFrame(rows, COLUMNS), MESSAGE).collect()}
    wrong = [(name, c) for k, (name, vote, c) in enumerate(CASES) if got[str(k)][name] != vote]
    assert not wrong


def patch(path, *lines):
    return "\n".join([f"diff --git a/{path} b/{path}", f"--- a/{path}", f"+++ b/{path}", "@@ -1 +1 @@", *lines])


DIFFS = [
    ({"lf_diff_sqli_fix": 1, "lf_diff_sql_parameterized": 1, "lf_diff_sql_query_touched": -1}, "m", ["a.py"], False, patch("a.py", "-run('SELECT a FROM b')", "+run('SELECT a FROM b', db_escape(x))")),
    ({"lf_diff_sql_query_touched": 0, "lf_diff_sqli_fix": -1}, "m", ["a.py"], False, patch("a.py", "+q = 'SELECT a FROM b'")),
    ({"lf_diff_sql_query_touched": -1}, "fix CVE-2024-1234", ["a.py"], False, patch("a.py", "+q = 'SELECT a FROM b'")),
    ({"lf_diff_sql_query_touched": -1}, "m", ["auth/a.py"], False, patch("a.py", "+q = 'SELECT a FROM b'")),
    ({"lf_diff_sqli_fix": -1, "lf_diff_sql_parameterized": -1}, "m", ["a.py"], True, patch("a.py", "+run('SELECT a FROM b', db_escape(x))")),
    ({"lf_diff_xss_fix": 1}, "m", ["a.js"], False, patch("a.js", "-e.innerHTML = x", "+e.textContent = x")),
    ({"lf_diff_path_normalization_added": -1}, "m", ["a.js"], False, patch("a.js", "+import x from '../x'")),
    ({"lf_diff_path_traversal_fix": 1}, "m", ["a.js"], False, patch("a.js", "+if (p.includes('..')) unlink(p)")),
    ({"lf_diff_authz_fix": 1}, "m", ["a.rb"], False, patch("a.rb", "+x = find_by(k)", "+abort(403)")),
    ({"lf_diff_memory_safety_fix": 1}, "m", ["a.c"], False, patch("a.c", "+if (n > max_len) return -EINVAL;", "+memcpy(a, b, n);")),
    ({"lf_diff_memory_safety_fix": -1}, "m", ["a.py"], False, patch("a.py", "+if (n > max_len) return -EINVAL;", "+memcpy(a, b, n);")),
    ({"lf_diff_dos_hardening_fix": 1}, "m", ["a.go"], False, patch("a.go", "+ReadAll(MaxBytesReader(r))")),
    ({"lf_diff_comment_names_concurrency_bug": 1}, "m", ["a.c"], False, patch("a.c", "+  // avoid the Data Race here")),
    ({"lf_diff_comment_names_concurrency_bug": -1}, "m", ["a.c"], False, patch("a.c", "+x(\"data race\")")),
    ({"lf_diff_output_escaping_added": -1}, "m", ["a"], False, patch("CHANGELOG.md", "+sanitize(x)")),
]


def test_diff_functions_and_their_structure(spark):
    rows = [(str(k), m, f, is_merge, d) for k, (_, m, f, is_merge, d) in enumerate(DIFFS)]
    commits = spark.createDataFrame(rows, "sha string, message string, files array<string>, is_merge boolean, diff_text string")
    for c, kind in (("subject", "string"), ("author_name", "string"), ("author_email", "string"), ("n_files", "int"), ("insertions", "int"), ("deletions", "int")):
        commits = commits.withColumn(c, F.lit(None).cast(kind))
    got = {r["sha"]: r for r in apply_lfs(with_hunks(commits), DIFF).collect()}
    wrong = [(k, name, vote, got[str(k)][name]) for k, (want, *_) in enumerate(DIFFS) for name, vote in want.items() if got[str(k)][name] != vote]
    assert not wrong
    families = [DIFF[k : k + 3] for k in range(0, 18, 3)]
    assert all(r[m.name] == 1 for r in got.values() for _, m, both in families if r[both.name] == 1)
    assert len(ALL_WITH_DIFF) == 42 and len({lf.name for lf in ALL_WITH_DIFF}) == 42


def plain_hunks(text):
    added, removed, kept, skip = [], [], 0, False
    for line in text.split("\n"):
        if kept > 200_000:
            break
        if line.startswith("diff --git "):
            skip = " b/" in line and line.split(" b/", 1)[1].endswith((".md", ".rst"))
        elif not skip and len(line) <= 500 and line[:1] in ("+", "-") and line[:3] not in ("+++", "---"):
            (added if line[0] == "+" else removed).append(line[1:])
            kept += len(line)
    return "\n".join(added), "\n".join(removed)


def test_hunks_match_a_plain_loop(spark):
    texts = [
        "+before\n-any header\n" + patch("a.c", "+x", " y", "-z", "+++ no", "+" + "w" * 499, "+" + "w" * 500),
        "diff --git without path\n+kept",
        patch("a.md", "+doc") + "\n" + patch("b.c", "+code", "-"),
        patch("a.c", *["+" + "v" * 400] * 300) + "\n" + patch("b.c", *["-" + "u" * 400] * 300),
        "",
        patch("a.c", "+end", ""),
    ]
    rows = [(str(k), t, False) for k, t in enumerate(texts)] + [("m", texts[0], True), ("n", None, None)]
    got = {r["sha"]: (r["diff_added"], r["diff_removed"]) for r in with_hunks(spark.createDataFrame(rows, "sha string, diff_text string, is_merge boolean")).collect()}
    for k, t in enumerate(texts):
        assert got[str(k)] == plain_hunks(t), k
    assert got["m"] == got["n"] == ("", "")


def test_prefilter_drops_before_it_cuts(spark):
    big = patch("bundle.js", *["+" + "x" * 1000] * 250)
    text = "lost\n" + big + "\n" + patch("a.md", "+doc") + "\n" + patch("src/a.c", "+kept") + "\ndiff --git nothing\n+gone"
    row = spark.createDataFrame([(text,)], "t string").select(prefiltered(F.col("t")).alias("p"), changed_paths(F.col("t")).alias("paths")).first()
    assert row["p"] == patch("src/a.c", "+kept") and row["paths"] == ["bundle.js", "a.md", "src/a.c"]


def test_release_windows_exclude_the_release_itself(spark):
    #        seed, release: the second release has no seed between; the third's own seed doesn't count
    rows = [(1, 1, True, False), (1, 2, False, True), (1, 3, False, False), (1, 4, True, True), (1, 5, True, False), (1, 6, False, True), (2, 1, False, True)]
    made = spark.createDataFrame(rows, "g int, t int, seed boolean, is_release boolean")
    for parts in (1, 3, 20):
        assert sorted((r["g"], r["t"]) for r in release_windows(made, "g", ["t"], parts).filter("fires").collect()) == [(1, 2), (1, 6)]


def test_release_windows_match_a_plain_loop(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(0, 0, 0, 1, None), t, pick(True, False, False, None), pick(True, False, False, None)) for t in range(600)]
    want, seen = {}, {}
    for g, t, seed, release in rows:
        want[t] = bool(release) and seen.get(g, False)
        seen[g] = False if release else bool(seen.get(g) or (seed and not release))
    made = spark.createDataFrame(rows, "g int, t int, seed boolean, is_release boolean")
    for parts in (None, 1, 37):
        got = {r["t"]: r["fires"] for r in release_windows(made, "g", ["t"], parts).collect()}
        assert got == want and 0 < sum(want.values()) < 600
    assert release_windows(made.limit(0), "g", ["t"]).count() == 0


def test_one_repository_and_day_is_many_tasks(spark):
    """10^6 commits of one day: each of 16 ranges holds about its share, and windows that span ranges are found."""
    day = spark.range(1_000_000).selectExpr("'o/r' AS repo", "'2024-01-01' AS author_date", "sha1(cast(id as string)) AS sha", "id % 5 = 0 AS seed", "id % 7 = 3 AS is_release")
    shares = day.repartitionByRange(16, "repo", "author_date", "sha").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = [r["count"] for r in shares.collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 1_000_000 / 16
    few = day.filter("id % 1000 < 10")
    want, seen = 0, False
    for r in sorted(few.collect(), key=lambda r: r["sha"]):
        want += r["is_release"] and seen
        seen = False if r["is_release"] else seen or r["seed"]
    assert release_windows(few, "repo", ["author_date", "sha"], 16).filter("fires").count() == want


def test_prefilter_cuts_at_its_limit(spark):
    sections = [patch(f"src/{k}.c", *["+" + chr(97 + k) * 999] * 190) for k in range(4)]
    text = "\n".join([patch("docs/a.md", "+gone"), *sections])
    whole = "\n".join(sections)
    assert all(len(s) <= 200_000 for s in sections) and len(whole) > 512_000
    got = spark.createDataFrame([(text,)], "t string").select(prefiltered(F.col("t")).alias("p")).first()["p"]
    assert got == whole[:512_000]


PY_COLUMNS = "sha string, message string, n_files int, lf_mine int"


def test_python_functions_vote_as_their_columns_do(spark):
    rows = [(f"s{k}", m, n, k) for k, (m, n) in enumerate([("fix CVE-2024-1234", 1), (None, 60), ("x", None), ("", 51), ("cve-2024-99999 too", 2)] * 40)]
    commits = spark.createDataFrame(rows, PY_COLUMNS).repartition(3)
    mine = row_function("py_cve", 1, ["message"], lambda m: 1 if m and re.search(r"\bCVE-\d{4}-\d{4,7}\b", m, re.IGNORECASE) else None)
    many = BatchFunction("py_many", 0, ("n_files",), lambda x: (x["n_files"] > 50).map({True: 0, False: None}))
    twin = LabelingFunction("twin_many", 0, "user", lambda: F.col("n_files") > 50)
    for lfs in ([mine, twin, many, next(lf for lf in ALL if lf.name == "lf_cve_id")], [many, mine]):
        commits_ = commits.withColumns({c: F.lit(v) for c, v in (("subject", ""), ("author_name", ""), ("author_email", ""))}).withColumns({"files": F.array(F.lit("a")), "is_merge": F.lit(False), "insertions": F.lit(0), "deletions": F.lit(0)})
        out = apply_lfs(commits_, lfs)
        assert out.columns[-len(lfs) :] == [lf.name for lf in lfs]
        for r in out.collect():
            assert r["py_many"] == (0 if (r["n_files"] or 0) > 50 else -1)
            assert "twin_many" not in out.columns or (r["py_many"], r["py_cve"]) == (r["twin_many"], r["lf_cve_id"])


@pytest.mark.parametrize(("vote", "said"), [(lambda x: 1 / 0, "division by zero"), (lambda x: [1], "1 votes on"), (lambda x: [2] * len(x), "votes other than"), (lambda x: x["absent"], "absent")])
def test_a_failing_function_is_named(spark, vote, said):
    commits = spark.createDataFrame([("s1", "m", 1, 0), ("s2", "m", 1, 0)], PY_COLUMNS).coalesce(1)
    with pytest.raises(Exception, match="(?s)labeling function py_bad: .*" + said):
        apply_lfs(commits, [BatchFunction("py_bad", 1, ("message",), vote)]).collect()


def test_citations_need_another_positive_commit(spark):
    log = lambda *refs: patch("CHANGELOG.md", *[f"+* fix ({r})" for r in refs])
    patches = spark.createDataFrame(
        [("aaaaaaa1", "v1.2", False, log("bbbbbbb")), ("ccccccc1", "v1.3", False, log("ccccccc1")), ("ddddddd1", "work", False, log("bbbbbbb")), ("eeeeeee1", "Merge", True, log("1234567 CVE-2024-1234")), ("fffffff1", "v2.0", False, patch("a.c", "+bbbbbbb"))],
        "sha string, subject string, is_merge boolean, diff_text string",
    )
    seeded = spark.createDataFrame([("bbbbbbb9", True), ("ccccccc1", True), ("1234567f", False)], "sha string, seed boolean")
    got = {r["sha"]: (r["patch_cites_advisory"], r["patch_cites_fix_commit"]) for r in citation_features(patches, seeded).collect()}
    assert got == {"aaaaaaa1": (False, True), "ccccccc1": (False, False), "eeeeeee1": (True, False), "fffffff1": (False, False)}


def test_features_default_to_false_and_user_functions_apply(spark):
    rows = [("s1", *commit("fix CVE-2024-1234")), ("s2", *commit("v1.0"))]
    commits = spark.createDataFrame(rows, COLUMNS).withColumns({"repo": F.lit("o/r"), "author_date": F.concat(F.lit("2024-01-0"), F.substring("sha", 2, 1))})
    got = {r["sha"]: r for r in with_features(commits).collect()}
    assert got["s2"]["release_window_positive"] and not got["s1"]["release_window_positive"] and not got["s2"]["patch_cites_fix_commit"]
    mine = LabelingFunction("lf_mine", 1, "user", lambda: F.when(F.col("subject") == "v1.0", True))
    assert {r["sha"]: r["lf_mine"] for r in apply_lfs(commits, [mine]).collect()} == {"s1": -1, "s2": 1}


@pytest.mark.parametrize("stream", [True])
def test_votes_on_a_stream(spark, tmp_path, stream):
    from patchlight.streaming.votes import commit_stream, voted

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"sha":"s1","repo":"o/r","message":"CVE-2024-1234","subject":"x"}\n')
    query = voted(commit_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("voted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["sha"], r["lf_cve_id"]) for r in spark.table("voted").collect()] == [("s1", 1)]


def test_wide_votes_keep_one_entry_for_each_id(spark):
    rows = [(1, "a", 0), (1, "a", 1), (1, "b", -1), (2, "b", 0), (2, "other", 1), (None, "a", 1), (3, "a", None)]
    wide = labeling.wide_votes(spark.createDataFrame(rows, "k int, lf string, vote tinyint"), ["a", "b"], "k")
    assert wide.columns == ["k", "a", "b"] and {tuple(r) for r in wide.collect()} == {(1, 1, -1), (2, None, 0), (None, 1, None), (3, None, None)}
    text = wide._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 1 and "pivot" not in text.lower()
