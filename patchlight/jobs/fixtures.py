"""Commit-shaped rows from the driver's tables, by arithmetic on ids.

Every derivation is an expression that Spark and the oracle's engine both read; only arrays are written differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import derived
from ..sources.tables import spread

SUBJECTS = [
    "Update the reader",
    "feat(core): add a faster path",
    "chore(main): release 0.2.3",
    "Bump version to 4.1.0",
    "Fix typo in the guide",
    "docs: describe the options",
    "v2.4.1",
    "Version Packages",
    "Merge branch main into next",
    "fix: handle malformed input without crash",
    "Refactor the parser and add a length check",
    "release: engine 4.4.0",
    "Rework stack overflow question page",
    "lint the scripts",
    "perf: keep the cache warm",
    "Add a test for the decoder",
    "ci: run on every branch",
    "x",
    "Fix the vulnerable login handler",
    "Correct an off by one in tests",
]
SECURITY_SUBJECTS = [
    "Fix CVE-2024-12345 in the session store",
    "Fixed GHSA-xrqc-p465-2xvg",
    "Prevent path traversal in uploads",
    "fix: integer overflow in image decoder (CWE-190)",
    "Reported by an outside team: tighten checks",
    "Backport security fix to the 2.x branch",
    "Avoid stack overflow in the parser, found by oss-fuzz",
    "Tidy the store",
]
FILES = [
    ["src/reader.py"],
    ["src/auth/login.py", "src/session/store.py"],
    ["docs/guide.md", "README"],
    ["tests/test_reader.py"],
    [".github/workflows/ci.yml"],
    ["lib/png_decoder.c", "lib/png_decoder.h"],
    [],
    ["security/2024-01-fix.rst", "lib/tarfile.py"],
    ["CHANGELOG.md", "package.json"],
    ["src/a.go", "src/b.go", "src/c.go", "src/crypto/d.go"],
    ["web/app.js", "web/view.html"],
    ["conf.d/notes"],
    ["a.c", "b.c", "parser/c.c", "d.c", "e.c"],
]


def _patch(path: str, *lines: str) -> str:
    return f"diff --git a/{path} b/{path}\nindex 1..2 100644\n--- a/{path}\n+++ b/{path}\n@@ -1,3 +1,3 @@\n" + "\n".join(lines)


PATCHES = [
    _patch("src/db.py", '-cursor.execute("SELECT a FROM t WHERE id=" + name)', '+cursor.execute("SELECT a FROM t WHERE id = ?", (name,))'),
    _patch("src/db.py", " context", '-rows = db_query("SELECT a FROM t")', '+rows = db_query("SELECT b FROM t")'),
    _patch("web/view.js", "-node.innerHTML = value;", "+node.textContent = value;"),
    _patch("web/view.js", "-node.innerHTML = a;", "+node.innerHTML = b;"),
    _patch("src/files.py", " name = given", "+full = realpath(os.path.join(base, name))", '+if ".." in name: raise ValueError'),
    _patch("src/files.py", "-p = os.path.join(a, b)", "+p = os.path.join(a, b, c)"),
    _patch("app/api.rb", " item = Item.find_by(id)", "+return access_denied if item.owner != current_user"),
    _patch("app/api.rb", "-item = Item.find_by(id)", "+item = Item.find_by(key)"),
    _patch("lib/png_decoder.c", " memcpy(dst, src, n);", "+if (n > max_len) return -EINVAL;", "+memcpy(dst, src, n);"),
    _patch("lib/png_decoder.c", "-memcpy(dst, src, n);", "+memcpy(dst, src, m);"),
    _patch("src/io.go", "-data := ReadAll(r)", "+data := ReadAll(MaxBytesReader(r, max_size))"),
    _patch("src/io.go", "-data := ReadAll(r)", "+data := ReadAll(body)"),
    _patch("lib/lock.c", "+// avoid the race condition where both sides close", "+lock(&m);"),
    _patch("CHANGELOG.md", "+* sanitize urls and escapeHtml everywhere"),
    _patch("docs/a.md", "+deadlock notes") + "\n" + _patch("src/a.js", "+el.innerHTML = escapeHtml(x);", "+" + "y" * 600),
    "+stray line before any header with sanitize(x)\n" + _patch("src/plain.txt", "+nothing"),
    "",
]


def text(value: str) -> str:
    """A string literal of both engines, without escapes."""
    out = "'"
    for ch in value:
        out += {"\n": "' || chr(10) || '", "'": "' || chr(39) || '", "\\": "' || chr(92) || '"}.get(ch, ch)
    return f"({out}')"


def pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _array(values: list[str], sql: bool) -> str:
    if not values:
        return "CAST([] AS VARCHAR[])" if sql else "CAST(array() AS array<string>)"
    inner = ", ".join(text(v) for v in values)
    return f"[{inner}]" if sql else f"array({inner})"


def hex_id(prefix: str, key: str) -> str:
    return f"md5('{prefix}' || CAST({key} AS STRING)) || substr(md5('s' || CAST({key} AS STRING)), 1, 8)"


def hour_stamp(n: str) -> str:
    """The n-th hour from 2024-01-01, in months of 28 days, as ISO text."""
    two = lambda x: f"lpad(CAST(CAST({x} AS BIGINT) AS STRING), 2, '0')"
    return f"'2024-' || {two(f'1 + floor({n} / 672) % 12')} || '-' || {two(f'1 + floor({n} / 24) % 28')} || 'T' || {two(f'{n} % 24')} || ':00:00+00:00'"


def commit_columns(sql: bool) -> dict[str, str]:
    """Expressions over ``documents`` left-joined to ``labels``."""
    k = "doc_id"
    hours = f"CAST(floor({k} / 40) AS BIGINT)"
    # Sources go by the id too; so that each has all subjects, theirs are shifted.
    turn = f"({k} + CAST(floor({k} / 20) AS BIGINT))"
    gold = "coalesce(toxic, 0) = 1"
    cites = f"'diff --git a/CHANGELOG.md b/CHANGELOG.md' || chr(10) || '+++ b/CHANGELOG.md' || chr(10) || '+* fix ([' || substr({hex_id('c', f'({k} - {k} % 7 - 20)')}, 1, 7) || '](x)) and 1234567, CVE-2024-' || CAST(1000 + {k} % 9000 AS STRING)"
    # A patch as long as the text, whose lines it adds and, halved, removes.
    header = "'diff --git a/src/notes.c b/src/notes.c' || chr(10) || '--- a/src/notes.c' || chr(10) || '+++ b/src/notes.c' || chr(10)"
    lines = f"{header} || '+' || replace(replace(text, '. ', '.' || chr(10)), chr(10), chr(10) || '+') || chr(10) || '-' || replace(replace(text, ', ', ',' || chr(10)), chr(10), chr(10) || '-')"
    return {
        "id": k,
        "sha": hex_id("c", k),
        "repo": "'org/' || source",
        "parents": f"CASE WHEN {k} % 29 = 0 THEN 'p1 p2' WHEN {k} % 31 = 1 THEN '' ELSE 'p1' END",
        "author_name": f"CASE WHEN {k} % 31 = 0 THEN 'dependabot[bot]' ELSE 'Dev ' || CAST({k} % 17 AS STRING) END",
        "author_email": f"CASE WHEN {k} % 31 = 0 THEN 'bot@users.example' ELSE 'dev@org.example' END",
        "author_date": hour_stamp(hours),
        "committer_name": "'Dev'",
        "committer_email": "'dev@org.example'",
        "committer_date": hour_stamp(f"({hours} + {k} % 3)"),
        "subject": f"CASE WHEN {gold} OR {k} % 13 = 5 THEN {pick(turn, [text(s) for s in SECURITY_SUBJECTS])} ELSE {pick(turn, [text(s) for s in SUBJECTS])} END",
        "body": "coalesce(text, '')",
        "files": f"CASE WHEN {k} % 20 = 17 THEN {_array([], sql)} ELSE {pick(k, [_array(f, sql) for f in FILES])} END",
        "insertions": "CAST(n_chars AS INT)",
        "deletions": "CAST(floor(n_chars / 3) AS INT)",
        "is_gold": gold,
        "diff_text": f"CASE WHEN {k} % 9 = 4 THEN {cites} WHEN {k} % 11 = 6 THEN {lines} ELSE {pick(k, [text(p) for p in PATCHES])} END",
    }


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(*[F.expr(e).alias(c) for c, e in commit_columns(sql=False).items()])


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(raw_commits(spark, sf_dir))


def commits_cte() -> str:
    """The oracle's twin of ``commits``."""
    cols = ", ".join(f"{e} AS {c}" for c, e in commit_columns(sql=True).items())
    return f"""raw AS (SELECT {cols} FROM documents LEFT JOIN labels USING (doc_id)),
commits AS (SELECT *, regexp_replace(subject || chr(10) || chr(10) || body, '^\\s+|\\s+$', '', 'g') AS message,
  CASE WHEN parents = '' THEN 0 ELSE len(string_split(parents, ' ')) END AS n_parents, parents LIKE '% %' AS is_merge, len(files) AS n_files FROM raw)"""


#: Votes over line items: a large vote matrix with known polarities.
VOTES = {
    "lf_returned": (1, "CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END"),
    "lf_large": (1, "CASE WHEN l_quantity >= 40 THEN 1 ELSE -1 END"),
    "lf_discounted": (1, "CASE WHEN l_discount >= 0.08 THEN 1 ELSE -1 END"),
    "lf_open": (0, "CASE WHEN l_linestatus = 'O' THEN 0 ELSE -1 END"),
    "lf_taxed": (0, "CASE WHEN l_tax >= 0.06 THEN 0 ELSE -1 END"),
    "lf_first_line": (0, "CASE WHEN l_linenumber = 1 THEN 0 ELSE -1 END"),
}
POLARITY = {c: p for c, (p, _) in VOTES.items()}


def vote_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = [F.col("l_orderkey"), F.col("l_linenumber"), F.concat(F.lit("org/"), F.col("l_suppkey").cast("string")).alias("repo"), (F.col("o_orderstatus") == "F").alias("is_gold")]
    return items.select(*key, *[F.expr(e).cast("tinyint").alias(c) for c, (_, e) in VOTES.items()])


def votes_cte() -> str:
    cols = ", ".join(f"CAST({e} AS TINYINT) AS {c}" for c, (_, e) in VOTES.items())
    yes = " + ".join(f"({c} = 1)::INT" for c in VOTES)
    no = " + ".join(f"({c} = 0)::INT" for c in VOTES)
    return f"""vm AS (SELECT l_orderkey, l_linenumber, 'org/' || l_suppkey::VARCHAR AS repo, o_orderstatus = 'F' AS is_gold, {cols}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT *, {yes} AS y, {no} AS n FROM vm),
m AS (SELECT *, CASE WHEN y > n THEN 1 WHEN n > y THEN 0 ELSE -1 END::TINYINT AS mv_label FROM v)"""


URLS = [
    ("'https://github.com/Org/Repo' || k || '/commit/' || h"),
    ("'https://github.com/org/repo' || k || '/commits/' || upper(substr(h, 1, 12))"),
    ("'https://www.github.com/Org/Repo' || k || '/pull/' || k"),
    ("'https://github.com/org/repo' || k || '/compare/v1...v2'"),
    ("'https://github.com/org/repo' || k || '/releases/tag/v' || k"),
    ("'https://api.github.com/repos/org/repo' || k || '/commits/' || substr(h, 1, 7)"),
    ("'https://api.github.com/org/repo' || k"),
    ("'https://github.com/Advisories/GHSA-' || k || '-x'"),
    ("'https://github.com/org/repo' || k || '.git'"),
    ("'https://github.com/org/repo' || k || ').'"),
    ("'https://github.com:443/org/repo' || k || '/commit/' || h"),
    ("'https://example.org/advisories/GHSA-' || k"),
    ("'https://github.com/org/repo' || k || '/commit/' || substr(h, 1, 6)"),
    ("'https://github.com/org/repo' || k || '/releases/tag'"),
    ("'https://github.com/org'"),
    ("'not a link ' || k"),
    ("'https://github.com/Org/Repo' || k || '/commit/' || h || ';x=1'"),
]


def url_expression(key: str, of: str) -> str:
    """A URL of one of seventeen shapes; ``of`` is the commit that it names."""
    k, h = f"CAST({of} % 20 AS STRING)", f"({hex_id('c', of)})"
    return pick(key, [u.replace("|| k", f"|| {k}").replace("(h,", f"({h},").replace("|| h", f"|| {h}") for u in URLS])


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed advisory pages: one item for each customer, its references from that customer's orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.expr(url_expression("o_orderkey", "o_orderkey")).alias("url"))
    tags = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Patch"), F.lit("Vendor"))).otherwise(F.array().cast("array<string>"))
    refs = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "url", tags.alias("tags")))).alias("r"), F.min("o_orderdate").alias("first"))
    joined = table(spark, sf_dir, "customer").join(refs, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select(
        F.expr(
            """struct(
              'CVE-2024-' || CAST(10000 + c_custkey AS STRING) AS id, date_format(first, 'yyyy-MM-dd') || 'T10:00:00' AS published, date_format(first, 'yyyy-MM-dd') || 'T12:00:00' AS lastModified,
              array(struct('de' AS lang, 'x' AS value), struct(CASE WHEN c_custkey % 5 = 0 THEN 'fr' ELSE 'en' END AS lang, c_name AS value)) AS descriptions,
              struct(CASE WHEN c_custkey % 3 = 0 THEN array(struct('Secondary' AS type, CAST(NULL AS STRING) AS baseSeverity, struct(1.0D AS baseScore, 'LOW' AS baseSeverity) AS cvssData), struct('Primary' AS type, CAST(NULL AS STRING) AS baseSeverity, struct(CAST(c_custkey % 100 AS DOUBLE) / 10 AS baseScore, 'HIGH' AS baseSeverity) AS cvssData)) END AS cvssMetricV31,
                     CASE WHEN c_custkey % 3 = 1 THEN array(struct('Secondary' AS type, CAST(NULL AS STRING) AS baseSeverity, struct(5.5D AS baseScore, 'MEDIUM' AS baseSeverity) AS cvssData)) END AS cvssMetricV30,
                     CASE WHEN c_custkey % 4 < 2 THEN array(struct('Primary' AS type, 'LOW' AS baseSeverity, struct(2.5D AS baseScore, CAST(NULL AS STRING) AS baseSeverity) AS cvssData)) END AS cvssMetricV2) AS metrics,
              array(struct(array(struct('en' AS lang, 'CWE-' || CAST(c_nationkey + 70 AS STRING) AS value), struct('en' AS lang, 'NVD-CWE-noinfo' AS value)) AS description), struct(array(struct('en' AS lang, 'CWE-' || CAST(c_custkey % 7 + 20 AS STRING) AS value)) AS description)) AS weaknesses,
              transform(r, x -> struct(x.url AS url, x.tags AS tags)) AS references)"""
        ).alias("cve"),
        F.array().alias("none"),
    ).select(F.array(F.struct("cve")).alias("vulnerabilities"))


def cves_cte() -> str:
    """The oracle's twin of ``nvd_records(advisories)``: columns of ``cves``, and ``links_raw`` in order of the references."""
    return f"""refs AS (SELECT o_custkey, o_orderkey, o_orderdate, {url_expression('o_orderkey', 'o_orderkey')} AS url, o_orderkey % 3 = 0 AS patch FROM orders),
cves AS (
  SELECT 'CVE-2024-' || (10000 + c_custkey)::VARCHAR AS cve_id, strftime(min(o_orderdate), '%Y-%m-%d') || 'T10:00:00' AS published, strftime(min(o_orderdate), '%Y-%m-%d') || 'T12:00:00' AS last_modified,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE any_value(c_name) END AS description,
    CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 100)::DOUBLE / 10 WHEN c_custkey % 3 = 1 THEN 5.5 WHEN c_custkey % 4 < 2 THEN 2.5 END::DOUBLE AS cvss_score,
    CASE WHEN c_custkey % 3 = 0 THEN 'HIGH' WHEN c_custkey % 3 = 1 THEN 'MEDIUM' WHEN c_custkey % 4 < 2 THEN 'LOW' END AS cvss_severity,
    list_sort(list_distinct(['CWE-' || (any_value(c_nationkey) + 70)::VARCHAR, 'CWE-' || (c_custkey % 7 + 20)::VARCHAR])) AS cwes,
    list(url ORDER BY o_orderkey) AS reference_urls, coalesce(list(url ORDER BY o_orderkey) FILTER (WHERE patch), []) AS patch_urls
  FROM customer JOIN refs ON o_custkey = c_custkey GROUP BY c_custkey),
exploded AS (SELECT cve_id, unnest(reference_urls) AS url, unnest(range(len(reference_urls))) AS pos FROM cves)"""


def osv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed open advisories: one for each part, with fixes in commits, a third of them shortened."""
    return table(spark, sf_dir, "part").select(F.expr(f"""struct(
        'GHSA-' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS array<string>) ELSE array('CVE-2024-' || CAST(10000 + p_partkey AS STRING)) END AS aliases,
        array(struct(array(struct(CASE WHEN p_partkey % 5 = 0 THEN 'SEMVER' ELSE 'GIT' END AS type, 'https://github.com/org/src' || CAST(p_partkey % 20 AS STRING) AS repo,
          array(struct('0' AS introduced, CAST(NULL AS STRING) AS fixed), struct(CAST(NULL AS STRING) AS introduced, CASE WHEN p_partkey % 3 = 0 THEN upper(substr({hex_id('c', 'p_partkey')}, 1, 9)) ELSE {hex_id('c', 'p_partkey')} END AS fixed)) AS events)) AS ranges)) AS affected,
        array(struct('FIX' AS type, {url_expression('p_partkey', 'p_partkey')} AS url), struct('WEB' AS type, 'https://github.com/org/x/commit/abcdef1' AS url)) AS references)""").alias("x")).select("x.*")


def osv_cte() -> str:
    h = hex_id("c", "p_partkey")
    return f"""osv AS (
  SELECT 'GHSA-' || p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 4 <> 0 THEN 'CVE-2024-' || (10000 + p_partkey)::VARCHAR END AS alias, p_partkey % 5 <> 0 AS git,
    'org/src' || (p_partkey % 20)::VARCHAR AS range_repo, lower(CASE WHEN p_partkey % 3 = 0 THEN substr({h}, 1, 9) ELSE {h} END) AS fixed, {url_expression('p_partkey', 'p_partkey')} AS url FROM part)"""
