"""The queries of ``queries`` in SQL, for an engine whose patterns have no lookahead and no Unicode classes."""

from __future__ import annotations

from ..functions import vocabulary as v
from ..operators.labeling import ALL_WITH_DIFF, FAMILIES, MESSAGE, POSITIVE
from .fixtures import POLARITY, VOTES, commits_cte, cves_cte, osv_cte, votes_cte
from .queries import CUTS, GIVEN_PRIOR, GIVEN_VOTES

#: The class pattern without its lookahead, and the alternative that has it, by counts.
_LOOKAHEAD = r"stack overflow(?!\s+question)|"
_PLAIN_CLASS = v.VULN_CLASS.replace(_LOOKAHEAD, "")


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def found(col: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({col}, {quoted(flags + pattern)})"


def n_found(col: str, pattern: str, flags: str = "(?i)") -> str:
    return f"len(regexp_extract_all({col}, {quoted(flags + pattern)}))"


def more(a: str, b: str, pattern: str, flags: str = "(?i)") -> str:
    return f"{n_found(a, pattern, flags)} > {n_found(b, pattern, flags)}"


def any_file(test: str, files: str = "files") -> str:
    return f"len(list_filter({files}, lambda x: {test})) > 0"


def all_files(test: str, files: str = "files") -> str:
    return f"(len({files}) > 0 AND len(list_filter({files}, lambda x: {test})) = len({files}))"


def _extension(x: str) -> str:
    return f"(CASE WHEN contains({x}, '.') THEN '.' || lower(string_split({x}, '.')[-1]) ELSE '' END)"


def document(x: str) -> str:
    kinds = ", ".join(f"'{e}'" for e in v.DOC_EXTENSIONS)
    return f"({_extension(x)} IN ({kinds}) OR {found(x, v.DOC_NAME)} OR starts_with(lower({x}), 'docs/'))"


def doc_path(x: str) -> str:
    return f"({document(x)} OR contains(lower({x}), '/changelog') OR contains(lower({x}), '.changeset/'))"


def release_subject(s: str = "subject") -> str:
    return f"({found(f'trim({s})', v.RELEASE_SUBJECT)} OR {found(f'trim({s})', v.VERSION_BUMP)})"


_CLASS = f"({found('message', _PLAIN_CLASS)} OR {n_found('message', 'stack overflow')} > {n_found('message', 'stack overflow' + chr(92) + 's+question')})"
_STRIPPED = r"regexp_replace(subject, '^\s+|\s+$', '', 'g')"

FACTS = f"""facts AS (SELECT *, {found('message', v.CVE)} AS cve, {found('message', v.GHSA)} AS ghsa, {found('message', v.CWE)} AS cwe, {_CLASS} AS class,
  {found('message', v.SECURITY_NOUN)} AS noun, {found('message', v.FIX_VERB)} AS fix, {found('message', v.ADVISORY)} AS adv,
  len(list_filter(files, lambda x: {found('x', v.SECURITY_PATH)})) AS sec_paths FROM commits)"""

CONDITIONS = {
    "lf_cve_id": "cve",
    "lf_ghsa_id": "ghsa",
    "lf_cwe_id": "cwe",
    "lf_vuln_class": "class",
    "lf_fix_plus_security_noun": "fix AND noun",
    "lf_advisory_language": "adv",
    "lf_security_backport": f"contains(lower(message), 'security') AND {found('lower(message)', v.BACKPORT, '')}",
    "lf_security_paths_and_fix": "fix AND sec_paths >= greatest(1, len(files) // 2)",
    "lf_security_note_path": f"{any_file(found('x', v.SECURITY_NOTE_DIR))} AND {any_file('NOT ' + doc_path('x'))}",
    "lf_bounds_check_in_parser": f"len(files) BETWEEN 1 AND 4 AND {any_file(found('x', v.PARSER_PATH))} AND {found('message', v.BOUNDS_CHECK)}",
    "lf_crash_on_untrusted_input": f"{found('message', v.CRASH)} AND {found('message', v.UNTRUSTED)}",
    "lf_docs_only": all_files(document("x")),
    "lf_tests_only": all_files(found("x", v.TEST_PATH)),
    "lf_ci_only": all_files(found("x", v.CI_PATH)),
    "lf_merge_commit": "is_merge AND NOT cve",
    "lf_bot_author": f"({found('author_email', v.BOT)} OR {found('author_name', v.BOT)}) AND NOT cve",
    "lf_version_bump": f"{found('subject', v.VERSION_BUMP)} AND NOT cve",
    "lf_typo_or_style": f"{found('subject', v.STYLE)} AND NOT noun",
    "lf_feature_commit": f"{found(_STRIPPED, v.CONVENTIONAL_PREFIX)} AND NOT noun AND NOT class",
    "lf_huge_diff": "(n_files > 50 OR insertions + deletions > 5000) AND NOT cve",
    "lf_empty_message": "length(message) < 8 AND len(files) = 0",
}


def _votes(lfs) -> str:
    return ", ".join(f"CASE WHEN {CONDITIONS[lf.name]} THEN {lf.polarity} ELSE -1 END::TINYINT AS {lf.name}" for lf in lfs)


_SEEDED = f"seeded AS (SELECT *, ({' OR '.join('(' + CONDITIONS[lf.name] + ')' for lf in POSITIVE)}) AS seed FROM facts)"
_WITH = f"WITH {commits_cte()}, {FACTS}"


def _sum(lfs, vote: int) -> str:
    return " + ".join(f"({lf.name} = {vote})::INT" for lf in lfs)


_MESSAGE = f"{_WITH}, voted AS (SELECT *, {_votes(MESSAGE)} FROM facts), counted AS (SELECT *, {_sum(MESSAGE, 1)} AS y, {_sum(MESSAGE, 0)} AS n FROM voted)"


def _lf_rows(names: dict[str, int], source: str, gold: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS lf, {p}::INT AS polarity, concat_ws(',', CASE WHEN bool_or({c} = 0) THEN '0' END, CASE WHEN bool_or({c} = 1) THEN '1' END) AS observed, count(*) FILTER (WHERE {c} <> -1) AS fired, (count(*) FILTER (WHERE {c} <> -1)) / count(*) AS coverage,
        (count(*) FILTER (WHERE {c} <> -1 AND y + n > 1)) / count(*) AS overlaps, (count(*) FILTER (WHERE ({c} = 1 AND n > 0) OR ({c} = 0 AND y > 0))) / count(*) AS conflicts,
        count(*) FILTER (WHERE {c} = {p} AND {gold}) AS gold_hits, count(*) FILTER (WHERE {c} <> -1 AND {c} = ({gold})::INT) AS correct,
        count(*) FILTER (WHERE {c} <> -1 AND {c} <> ({gold})::INT) AS incorrect,
        CASE WHEN count(*) FILTER (WHERE {c} <> -1) > 0 THEN (count(*) FILTER (WHERE {c} <> -1 AND {c} = ({gold})::INT)) / (count(*) FILTER (WHERE {c} <> -1)) END AS accuracy FROM {source}"""
        for c, p in names.items()
    )


_MATRIX = f"WITH {votes_cte()}"

# Sections of a patch: cut before each header, and what stands before the first.
_SECTIONS = r"""cut AS (SELECT *, list_filter(list_transform(string_split(chr(10) || diff_text, chr(10) || 'diff --git '), lambda s, i: CASE WHEN i > 1 THEN 'diff --git ' || s ELSE substr(s, 2) END), lambda s: true) AS parts FROM commits),
sec AS (SELECT sha, subject, is_merge, files, message, unnest(parts) AS s, unnest(range(len(parts))) AS k FROM cut),
pathed AS (SELECT *, CASE WHEN starts_with(s, 'diff --git ') AND contains(string_split(s, chr(10))[1], ' b/') THEN array_to_string(string_split(string_split(s, chr(10))[1], ' b/')[2:], ' b/') ELSE '' END AS path FROM sec)"""
_LINES = f"""ln AS (SELECT sha, k, unnest(string_split(s, chr(10))) AS x, unnest(range(len(string_split(s, chr(10))))) AS p FROM pathed WHERE NOT {doc_path('path')} AND NOT is_merge),
signed AS (SELECT *, sum(length(x)) OVER (PARTITION BY sha ORDER BY k, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ln
  WHERE left(x, 1) IN ('+', '-') AND left(x, 3) NOT IN ('+++', '---') AND length(x) <= 500),
hunks AS (SELECT sha, coalesce(string_agg(substr(x, 2), chr(10) ORDER BY k, p) FILTER (WHERE left(x, 1) = '+'), '') AS a, coalesce(string_agg(substr(x, 2), chr(10) ORDER BY k, p) FILTER (WHERE left(x, 1) = '-'), '') AS r
  FROM signed WHERE coalesce(before, 0) <= 200000 GROUP BY sha),
patched AS (SELECT f.*, coalesce(h.a, '') AS a, coalesce(h.r, '') AS r FROM facts f LEFT JOIN hunks h USING (sha))"""


def _either(p: str) -> str:
    return f"({found('a', p)} OR {found('r', p)})"


_SYSTEM = any_file(r"regexp_matches(lower(x), '\.(" + "|".join(e.lstrip(".") for e in v.SYSTEM_EXTENSIONS) + ")$')")
_DIFF_FACTS = f"""df AS (SELECT *, {_either(v.SQL_SURFACE)} AS f_sql, {more('a', 'r', v.SQL_PARAM)} OR {more('r', 'a', v.SQL_RAW_INTERP)} AS b_sql,
  {_either(v.XSS_SINK)} AS f_xss, {more('a', 'r', v.XSS_ESCAPE)} OR {more('r', 'a', v.XSS_HTML_CONCAT, '')} OR {more('r', 'a', v.XSS_SINK)} AS b_xss,
  {_either(v.PATH_SURFACE)} AS f_path, {more('a', 'r', v.PATH_MITIG)} AS b_path, {_either(v.AUTHZ_SURFACE)} AS f_authz, {more('a', 'r', v.AUTHZ_MITIG)} AS b_authz,
  {_SYSTEM} AND {_either(v.MEM_SURFACE)} AS f_memory,
  {_SYSTEM} AND ({more('a', 'r', v.MEM_MITIG, '')} OR ({found('a', v.MEM_GUARD, '')} AND ({more('a', 'r', v.MEM_GUARD, '')} OR {more('a', 'r', v.MEM_REJECT, '')}))) AS b_memory,
  {_either(v.DOS_SURFACE)} AS f_dos, {more('a', 'r', v.DOS_MITIG)} AS b_dos,
  {found(f"array_to_string(list_filter(string_split(a, chr(10)), lambda x: {found('x', v.COMMENT_LINE, '')}), chr(10))", v.CONCURRENCY_COMMENT)} AS conc,
  cve OR ghsa OR cwe OR class OR noun OR adv OR sec_paths > 0 AS flavoured FROM patched),
dg AS (SELECT *, flavoured OR b_sql OR b_xss OR b_path OR b_authz OR b_memory OR b_dos AS excused FROM df)"""
_DIFF_VOTES = ", ".join(
    f"CASE WHEN f_{f} AND NOT excused THEN 0 ELSE -1 END::TINYINT AS {s}, CASE WHEN b_{f} THEN 1 ELSE -1 END::TINYINT AS {m}, CASE WHEN f_{f} AND b_{f} THEN 1 ELSE -1 END::TINYINT AS {b}" for f, s, m, b in FAMILIES
) + ", CASE WHEN conc THEN 1 ELSE -1 END::TINYINT AS lf_diff_comment_names_concurrency_bug"

_WINDOW = f"""rel AS (SELECT *, {release_subject()} AS is_release FROM seeded),
segs AS (SELECT *, coalesce(sum(is_release::INT) OVER (PARTITION BY repo ORDER BY author_date, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM rel),
fired AS (SELECT *, is_release AND max((seed AND NOT is_release)::INT) OVER (PARTITION BY repo, seg) = 1 AS release_window_positive FROM segs)"""

_HOSTS = ", ".join(f"'{h}'" for h in v.GITHUB_HOSTS)
_RESERVED = ", ".join(f"'{o}'" for o in v.RESERVED_OWNERS)


def links(source: str, keys: str) -> str:
    """CTE ``links`` with the parsed parts of ``source``'s url."""
    return rf"""l0 AS (SELECT {keys}, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  list_filter(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/'), lambda x: x <> '') AS p FROM {source}),
l1 AS (SELECT *, CASE WHEN host = 'api.github.com' THEN CASE WHEN len(p) >= 3 AND p[1] = 'repos' THEN p[2:] END WHEN host IN ({_HOSTS}) THEN p END AS q FROM l0),
l2 AS (SELECT *, q[1] AS owner, regexp_replace(regexp_replace(trim(q[2]), '\.git$', ''), '[.,);\]''"]+$', '') AS name, q[3] AS section, q[4] AS val FROM l1),
links AS (SELECT {keys}, url, owner, name, lower(owner || '/' || name) AS repo_key,
  CASE WHEN section IN ('commit', 'commits') AND regexp_matches(lower(val), '^[0-9a-f]{{7,40}}$') THEN 'commit' WHEN section = 'pull' AND regexp_matches(val, '^[0-9]+$') THEN 'pull'
       WHEN section = 'compare' AND val IS NOT NULL THEN 'compare' WHEN section = 'releases' AND val = 'tag' AND q[5] IS NOT NULL THEN 'release' END AS kind,
  CASE WHEN section IN ('commit', 'commits') AND regexp_matches(lower(val), '^[0-9a-f]{{7,40}}$') THEN lower(val) WHEN section = 'pull' AND regexp_matches(val, '^[0-9]+$') THEN val
       WHEN section = 'compare' THEN val WHEN section = 'releases' AND val = 'tag' THEN q[5] END AS id
  FROM l2 WHERE name IS NOT NULL AND name <> '' AND lower(owner) NOT IN ({_RESERVED}))"""


_CVE_LINKS = f"{cves_cte()}, {links('exploded', 'cve_id, pos')}"
_PRIMARY = """per AS (SELECT cve_id, repo_key, count(kind) AS patches, min(pos) FILTER (WHERE kind IS NOT NULL) AS early FROM links GROUP BY 1, 2),
primaries AS (SELECT cve_id, coalesce(first(repo_key ORDER BY patches DESC, early) FILTER (WHERE patches > 0), CASE WHEN count(*) = 1 THEN min(repo_key) END) AS primary_repo FROM per GROUP BY 1)"""
_FIXES = f"""{osv_cte()}, o0 AS (SELECT id AS osv, url FROM osv), {links('o0', 'osv').replace('links AS', 'olinks AS').replace('l0', 'o1').replace('l1', 'o2').replace('l2', 'o3')},
osv_fixes AS (SELECT osv_id, repo_key, commit, min(source) AS source FROM (
  SELECT id AS osv_id, range_repo AS repo_key, fixed AS commit, 'range' AS source FROM osv WHERE git AND fixed <> ''
  UNION ALL SELECT osv, repo_key, id, 'reference' FROM olinks WHERE kind = 'commit') GROUP BY 1, 2, 3),
fixes AS (SELECT DISTINCT alias AS cve_id, repo_key, commit, source FROM osv_fixes JOIN osv ON osv.id = osv_id JOIN cves ON cves.cve_id = alias)"""
_TARGETS = f"""{_PRIMARY}, edges AS (
  SELECT DISTINCT l.repo_key, l.cve_id, NULL AS commit, NULL AS pr FROM links l JOIN primaries p USING (cve_id) WHERE p.primary_repo IS NULL OR p.primary_repo = l.repo_key
  UNION ALL SELECT repo_key, cve_id, CASE WHEN kind = 'commit' THEN id END, CASE WHEN kind = 'pull' THEN id END FROM links WHERE kind IN ('commit', 'pull')
  UNION ALL SELECT repo_key, cve_id, commit, NULL FROM fixes),
targets AS (SELECT repo_key, list_sort(list(DISTINCT cve_id)) AS cve_ids, coalesce(list_sort(list(DISTINCT commit) FILTER (WHERE commit IS NOT NULL)), []) AS fix_commits,
  coalesce(list_sort(list(DISTINCT pr) FILTER (WHERE pr IS NOT NULL)), []) AS fix_prs FROM edges GROUP BY 1)"""
_GOLD = f"""refs7 AS (SELECT repo_key, commit, max(cve_id) AS cve_id FROM (SELECT cve_id, repo_key, id AS commit FROM links WHERE kind = 'commit' UNION SELECT cve_id, repo_key, commit FROM fixes) GROUP BY 1, 2),
every7 AS (SELECT DISTINCT cve_id, repo_key, commit FROM (SELECT cve_id, repo_key, id AS commit FROM links WHERE kind = 'commit' UNION ALL SELECT cve_id, repo_key, commit FROM fixes)),
one AS (SELECT e.repo_key, e.commit, count(*) AS n, min(c.sha) AS sha FROM (SELECT DISTINCT repo_key, commit FROM every7) e JOIN commits c ON lower(c.repo) = e.repo_key AND starts_with(c.sha, e.commit) GROUP BY 1, 2),
resolved AS (SELECT e.*, coalesce(CASE WHEN n = 1 THEN one.sha END, e.commit) AS full_sha FROM every7 e LEFT JOIN one USING (repo_key, commit)),
known AS (SELECT repo_key, full_sha, list_sort(list(DISTINCT cve_id)) AS cve_ids FROM resolved GROUP BY 1, 2),
golden AS (SELECT c.*, k.cve_ids IS NOT NULL AS is_cve_fix, k.cve_ids[1] AS cve_id, coalesce(array_to_string(k.cve_ids, ','), '') AS all_cves, coalesce(array_to_string(t.cve_ids, ','), '') AS repo_cve_ids
  FROM commits c LEFT JOIN known k ON k.repo_key = lower(c.repo) AND k.full_sha = c.sha LEFT JOIN targets t ON t.repo_key = lower(c.repo))"""
_ALL = f"WITH {commits_cte()}, {_CVE_LINKS}, {_FIXES}, {_TARGETS}, {_GOLD}"
_STRATA = f"{_SEEDED}, kinds AS (SELECT *, CASE WHEN is_gold THEN 'gold' WHEN seed THEN 'positive' ELSE 'control' END AS stratum FROM seeded), drawn AS (SELECT * FROM kinds WHERE stratum <> 'control' UNION ALL (SELECT * FROM kinds WHERE stratum = 'control' ORDER BY md5('42:' || sha), sha LIMIT 200))"
_PRED = "(y - n)::DOUBLE / 10 + 0.5"
_YES = ", ".join(f"CASE WHEN {c} = 1 THEN '{c}' END" for c in VOTES)
_NO = ", ".join(f"CASE WHEN {c} = 0 THEN '{c}' END" for c in VOTES)
_NAMES = ", ".join(VOTES)

_CITED = f"""asked AS (SELECT sha FROM commits WHERE {release_subject()} OR is_merge),
notes AS (SELECT sha, k, unnest(string_split(s, chr(10))) AS x, unnest(range(len(string_split(s, chr(10))))) AS p FROM pathed SEMI JOIN asked USING (sha) WHERE regexp_matches(path, '(\\.md|\\.rst)$|(^|/)\\.changeset/|NEWS|CHANGES')),
added AS (SELECT a.sha, coalesce(string_agg(substr(x, 2), chr(10) ORDER BY k, p), '') AS t FROM asked a LEFT JOIN (SELECT * FROM notes WHERE left(x, 1) = '+' AND left(x, 3) <> '+++') USING (sha) GROUP BY a.sha),
cited AS (SELECT DISTINCT sha, left(ref, 7) AS p7 FROM (SELECT sha, unnest(regexp_extract_all(t, '{v.SHA_REFERENCE}', 1)) AS ref FROM added)),
hits AS (SELECT DISTINCT sha FROM cited WHERE p7 <> left(sha, 7) AND p7 IN (SELECT left(sha, 7) FROM seeded WHERE seed))"""
_EVERY = f"""mv AS (SELECT sha, is_gold, is_merge, {_votes(MESSAGE)} FROM facts), dv AS (SELECT sha, {_DIFF_VOTES} FROM dg),
av AS (SELECT mv.*, dv.* EXCLUDE (sha), CASE WHEN w.release_window_positive THEN 1 ELSE -1 END::TINYINT AS lf_release_of_security_fix,
  CASE WHEN NOT mv.is_merge AND h.sha IS NOT NULL THEN 1 ELSE -1 END::TINYINT AS lf_patch_cites_fix_commit
  FROM mv JOIN dv USING (sha) JOIN fired w USING (sha) LEFT JOIN hits h USING (sha)),
ac AS (SELECT *, {_sum(ALL_WITH_DIFF, 1)} AS y, {_sum(ALL_WITH_DIFF, 0)} AS n FROM av)"""

_IS_CODE = f"NOT (len(z) > 0 AND len(list_filter(z, lambda x: {found('x', v.CODE_EXTENSION, '')} AND NOT {found('x', v.RELEASE_FILE)})) = 0)"
_CODED = f"""coded AS (SELECT c.*, {_IS_CODE} AS is_code, (y - n)::DOUBLE / 10 + 0.5 AS prob_security, CASE WHEN y > n THEN 1 WHEN n > y THEN 0 ELSE -1 END::TINYINT AS mv_label,
  CASE WHEN y + n = 0 THEN -1 WHEN (y - n)::DOUBLE / 10 + 0.5 >= 0.6::DOUBLE THEN 1 ELSE 0 END::TINYINT AS label
  FROM (SELECT *, regexp_extract_all(diff_text, '(?m)^diff --git a/.* b/(.*)$', 1) AS z FROM counted) c)"""
_FIRED_NAMES = lambda polarity, vote: ", ".join(f"CASE WHEN {lf.name} = {vote} THEN '{lf.name}' END" for lf in MESSAGE if lf.polarity == polarity)

_STORED = f"""WITH {commits_cte()}, stored AS (
  SELECT CASE WHEN id % 3 = 0 THEN 'org/src0' ELSE repo END AS repo, sha, subject, n_files::INT AS n_files, is_gold FROM commits, (VALUES (1), (2)) AS twice(k))"""
_ODDS = " + ".join(f"CASE WHEN {c} = {POLARITY[c]} THEN ln({a}::DOUBLE) - ln({b}::DOUBLE) ELSE 0 END" for c, (a, b) in GIVEN_VOTES.items())
_GIVEN = f"""given AS (SELECT *, CASE WHEN y + n = 0 THEN -1 WHEN p >= 0.5::DOUBLE THEN 1 ELSE 0 END::TINYINT AS label
  FROM (SELECT *, 1 / (1 + exp(-(ln({GIVEN_PRIOR}::DOUBLE / {1 - GIVEN_PRIOR}::DOUBLE) + {_ODDS}))) AS p FROM m))"""

SQL = {
    "vote_unions": f"{_MATRIX} "
    + " UNION ALL ".join(
        f"SELECT {p}::INT AS polarity, {sum(q == p for q in POLARITY.values())}::INT AS lfs, (count(*) FILTER (WHERE {x} > 0)) / count(*) AS covered, sum({x}) / count(*) AS summed, (count(*) FILTER (WHERE y > 0 AND n > 0)) / count(*) AS both FROM m"
        for p, x in ((1, "y"), (0, "n"))
    ),
    "code_gold_hits": f"{_MESSAGE}, {_CODED} " + " UNION ALL ".join(f"SELECT '{lf.name}' AS lf, count(*) FILTER (WHERE {lf.name} = {lf.polarity} AND is_gold) AS gold_hits, count(*) FILTER (WHERE {lf.name} = {lf.polarity} AND is_gold AND is_code) AS code_gold_hits FROM coded" for lf in MESSAGE),
    "code_vetoes": f"{_MESSAGE}, {_CODED}, f AS (SELECT y, is_code, label, unnest(list_filter([{_FIRED_NAMES(0, 0)}], lambda x: x IS NOT NULL)) AS lf FROM coded WHERE is_gold) SELECT lf, count(*) AS n, count(*) FILTER (WHERE y = 0) AS lone, count(*) FILTER (WHERE is_code) AS on_code, count(*) FILTER (WHERE label <> 1) AS on_missed FROM f GROUP BY 1",
    "gold_rows": f"{_MESSAGE}, {_CODED} SELECT sha, array_to_string(list_filter([{_FIRED_NAMES(1, 1)}], lambda x: x IS NOT NULL), ',') AS positives, array_to_string(list_filter([{_FIRED_NAMES(0, 0)}], lambda x: x IS NOT NULL), ',') AS vetoes, mv_label, prob_security, label, is_code FROM coded WHERE is_gold",
    "ranked_conjunctions": f"{_WITH}, {_STRATA}, {_SECTIONS}, {_LINES}, {_DIFF_FACTS}, c AS (SELECT stratum, {_DIFF_VOTES} FROM dg JOIN (SELECT sha, stratum FROM drawn) USING (sha)), k AS ("
    + " UNION ALL ".join(f"SELECT '{b}' AS lf, count(*) FILTER (WHERE stratum = 'gold' AND {b} = 1) AS gold_hits, count(*) FILTER (WHERE stratum = 'control' AND {b} = 1) AS fired, count(*) FILTER (WHERE stratum = 'control') AS n FROM c" for *_, b in FAMILIES)
    + """), r AS (SELECT *, CASE WHEN n > 0 THEN fired / n ELSE 0 END::DOUBLE AS rate FROM k)
      SELECT row_number() OVER (ORDER BY rate, gold_hits, lf)::INT AS rank, lf, gold_hits, fired, rate, floor(rate * (SELECT count(*) FROM commits))::BIGINT AS expected,
        CASE WHEN gold_hits = 0 THEN 'no gold evidence' WHEN rate <= 0.001 THEN 'high precision' WHEN rate <= 0.005 THEN 'usable' WHEN rate <= 0.015 THEN 'loose' ELSE 'too loose' END AS verdict FROM r""",
    "fired_on": f"{_MATRIX} SELECT count(*) FILTER (WHERE lf_large <> -1) AS n, (count(*) FILTER (WHERE lf_large <> -1)) / count(*) AS share FROM m",
    "fired_on_in_repo": f"{_MATRIX} SELECT count(*) FILTER (WHERE lf_large <> -1) AS n, (count(*) FILTER (WHERE lf_large <> -1)) / count(*) AS share FROM m WHERE repo = 'org/1'",
    "attached_sample": f"{_WITH}, {_STRATA} SELECT sha, stratum, repo, n_files::INT AS n_files FROM drawn",
    "cwe_of_missed": f"{_ALL}, {FACTS}, voted AS (SELECT sha, {_votes(MESSAGE)} FROM facts), w AS (SELECT sha FROM voted WHERE {_sum(MESSAGE, 1)} <= {_sum(MESSAGE, 0)}) SELECT cwe, count(*) AS n FROM (SELECT unnest(c.cwes) AS cwe FROM golden g JOIN cves c USING (cve_id) JOIN w USING (sha) WHERE is_cve_fix) GROUP BY 1",
    "all_lf_summary": f"{_WITH}, {_SEEDED}, {_WINDOW}, {_SECTIONS}, {_LINES}, {_DIFF_FACTS}, {_CITED}, {_EVERY} {_lf_rows({lf.name: lf.polarity for lf in ALL_WITH_DIFF}, 'ac', 'is_gold')}",
    "lf_summary": f"{_MESSAGE} {_lf_rows({lf.name: lf.polarity for lf in MESSAGE}, 'counted', 'is_gold')}",
    "lf_votes": f"{_MESSAGE} SELECT sha, {', '.join(lf.name for lf in MESSAGE)}, CASE WHEN y > n THEN 1 WHEN n > y THEN 0 ELSE -1 END::TINYINT AS mv_label FROM counted",
    "seed_votes": f"{_WITH}, {_SEEDED} SELECT sha, seed FROM seeded",
    "release_window": f"{_WITH}, {_SEEDED}, {_WINDOW} SELECT repo, sha, release_window_positive FROM fired",
    "release_log": """WITH e AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS rel, event_type = 'error' AS seed FROM events),
      s AS (SELECT *, coalesce(sum(rel::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e)
      SELECT event_id, rel AND max((seed AND NOT rel)::INT) OVER (PARTITION BY user_id, seg) = 1 AS fires FROM s""",
    "diff_hunks": f"{_WITH}, {_SECTIONS}, {_LINES} SELECT sha, a AS diff_added, r AS diff_removed FROM patched",
    "diff_votes": f"{_WITH}, {_SECTIONS}, {_LINES}, {_DIFF_FACTS} SELECT sha, {_DIFF_VOTES} FROM dg",
    "diff_prefilter": f"WITH {commits_cte()}, {_SECTIONS}, kept AS (SELECT sha, string_agg(s, chr(10) ORDER BY k) AS t FROM pathed WHERE path <> '' AND NOT {doc_path('path')} AND length(s) <= 200000 GROUP BY 1) SELECT sha, coalesce(left(t, 512000), '') AS patch FROM commits LEFT JOIN kept USING (sha)",
    "diff_lines": f"""WITH {commits_cte()}, {_SECTIONS}, f AS (SELECT sha, path, s, row_number() OVER (PARTITION BY sha ORDER BY k) - 1 AS file_pos FROM pathed WHERE starts_with(s, 'diff --git ')),
      l AS (SELECT sha, path, file_pos, unnest(string_split(s, chr(10))) AS x, unnest(range(len(string_split(s, chr(10))))) AS line_pos FROM f)
      SELECT sha, path, file_pos::INT AS file_pos, line_pos::INT AS line_pos, CASE WHEN left(x, 3) IN ('+++', '---') THEN 'h' WHEN left(x, 1) IN ('+', '-') THEN left(x, 1) ELSE ' ' END AS sign, x AS text FROM l""",
    "changed_paths": rf"WITH {commits_cte()} SELECT sha, array_to_string(list_distinct_ordered, '|') AS paths, len(list_distinct_ordered) > 0 AND len(list_filter(list_distinct_ordered, lambda x: {found('x', v.CODE_EXTENSION, '')} AND NOT {found('x', v.RELEASE_FILE)})) = 0 AS release_only FROM (SELECT sha, list_transform(list_filter(list_zip(z, range(len(z))), lambda t: list_position(z, t[1]) = t[2] + 1), lambda t: t[1]) AS list_distinct_ordered FROM (SELECT sha, regexp_extract_all(diff_text, '(?m)^diff --git a/.* b/(.*)$', 1) AS z FROM commits))",
    "diff_excerpt": f"""WITH {commits_cte()}, {_SECTIONS}, f AS (SELECT sha, s, row_number() OVER (PARTITION BY sha ORDER BY k) - 1 AS fp FROM pathed WHERE starts_with(s, 'diff --git ')),
      l AS (SELECT sha, fp, length(s) AS chars, unnest(string_split(s, chr(10))) AS x, unnest(range(len(string_split(s, chr(10))))) AS lp FROM f),
      t AS (SELECT *, fp < 20 AND lp < CASE WHEN chars > 40000 THEN 4 ELSE 150 END AS fits FROM l),
      u AS (SELECT *, fits AND sum(fits::INT) OVER (PARTITION BY sha ORDER BY fp, lp ROWS UNBOUNDED PRECEDING) <= 600 AS shown FROM t)
      SELECT sha, count(DISTINCT fp) AS n_files, count(DISTINCT fp) FILTER (WHERE shown) AS n_files_shown, count(*) AS n_lines, count(*) FILTER (WHERE shown) AS n_lines_shown,
        coalesce(string_agg(left(x, 500), chr(10) ORDER BY fp, lp) FILTER (WHERE shown), '') AS excerpt FROM u GROUP BY sha""",
    "citations": f"{_WITH}, {_SEEDED}, {_SECTIONS}, {_CITED} SELECT sha, {found('t', v.ADVISORY_ID)} AS patch_cites_advisory, sha IN (SELECT sha FROM hits) AS patch_cites_fix_commit FROM added",
    "stratified_sample": f"{_WITH}, {_STRATA} SELECT sha, stratum FROM drawn",
    "stratum_sizes": f"{_WITH}, {_STRATA} SELECT stratum, count(*) AS n, sum(length(diff_text))::BIGINT AS chars, count(*) FILTER (WHERE diff_text = '') AS empty FROM drawn GROUP BY 1",
    "seeded_sample": f"WITH {commits_cte()} SELECT sha, repo FROM commits ORDER BY md5('7:' || sha), sha LIMIT 100",
    "control_rates": f"{_WITH}, {_STRATA}, cv AS (SELECT {_votes(POSITIVE)} FROM drawn WHERE stratum = 'control'), k AS ("
    + " UNION ALL ".join(f"SELECT '{lf.name}' AS lf, count(*) FILTER (WHERE {lf.name} <> -1) AS fired, count(*) AS n FROM cv" for lf in POSITIVE)
    + """), w AS (SELECT *, fired / n AS p, 1 + 1.96 * 1.96 / n AS s FROM k)
      SELECT lf, fired, n, p AS rate, greatest(0, (p + 1.96 * 1.96 / (2 * n)) / s - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / s)::DOUBLE AS low,
        least(1, (p + 1.96 * 1.96 / (2 * n)) / s + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / s)::DOUBLE AS high,
        CASE WHEN p < 0.005 THEN 'precise' WHEN p < 0.02 THEN 'usable' ELSE 'loose' END AS verdict FROM w""",
    "control_trips": f"{_WITH}, {_STRATA}, {_SECTIONS}, {_LINES}, {_DIFF_FACTS}, c AS (SELECT {_DIFF_VOTES} FROM dg SEMI JOIN (SELECT sha FROM drawn WHERE stratum = 'control') USING (sha)), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE greatest({', '.join(b for *_, b in FAMILIES)}) = 1) AS tripped FROM c) SELECT n, tripped, tripped / n AS rate, tripped / n * (SELECT count(*) FROM commits) AS expected FROM t",
    "family_table": f"{_WITH}, {_SECTIONS}, {_LINES}, {_DIFF_FACTS}, c AS (SELECT is_gold, {_DIFF_VOTES} FROM dg) "
    + " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) FILTER (WHERE is_gold AND {s} = 0) AS surface_vetoes, count(*) FILTER (WHERE is_gold AND {m} = 1) AS mitigation_hits, count(*) FILTER (WHERE is_gold AND {b} = 1) AS both_hits FROM c" for f, s, m, b in FAMILIES),
    "fired_sample": f"{_WITH} SELECT sha, repo, subject FROM facts WHERE class ORDER BY md5('5:' || sha), sha LIMIT 20",
    "kept_cves": f"WITH {_CVE_LINKS}, k AS (SELECT cve_id, count(kind) AS n_patch_refs FROM links GROUP BY 1 HAVING count(kind) > 0) SELECT cve_id, published, n_patch_refs FROM cves JOIN k USING (cve_id) ORDER BY published, cve_id LIMIT 100",
    "weak_functions": f"{_MESSAGE}, w AS ({_lf_rows({lf.name: lf.polarity for lf in MESSAGE}, 'counted', 'is_gold')}) SELECT lf, fired, CASE WHEN fired = 0 THEN 'dead' ELSE 'thin' END AS state FROM w WHERE coverage < 0.01",
    "majority_vote": f"{_MATRIX} SELECT l_orderkey, l_linenumber, mv_label FROM m",
    "vote_patterns": f"{_MATRIX} SELECT {_NAMES}, count(*) AS n FROM vm GROUP BY ALL",
    "votes_long": f"{_MATRIX} " + " UNION ALL ".join(f"SELECT '{c}' AS lf, {c} AS vote, count(*) AS n FROM vm GROUP BY 2" for c in VOTES),
    "votes_wide": f"{_MATRIX} SELECT l_orderkey, l_linenumber, {', '.join(f'max({c}) AS {c}' for c in VOTES)} FROM vm GROUP BY 1, 2",
    "vote_table": f"{_MATRIX} {_lf_rows(POLARITY, 'm', 'is_gold')}",
    "vote_headline": f"""{_MATRIX} SELECT count(*) AS n_rows, count(*) FILTER (WHERE y + n > 0) AS any_vote, count(*) FILTER (WHERE y + n = 0) AS no_vote, count(*) FILTER (WHERE mv_label = 1) AS flagged,
      count(*) FILTER (WHERE is_gold) AS gold, count(*) FILTER (WHERE is_gold AND mv_label = 1) AS gold_by_model, count(*) FILTER (WHERE is_gold AND mv_label = 1) AS gold_by_majority,
      count(*) FILTER (WHERE is_gold AND y > 0) AS gold_with_positive, count(*) FILTER (WHERE is_gold AND n > 0) AS gold_vetoed, count(*) FILTER (WHERE y > 0) AS any_positive,
      count(*) FILTER (WHERE n > 0) AS any_negative, count(*) FILTER (WHERE y > 0 AND n > 0) AS both_sides FROM m""",
    "threshold_sweep": f"{_MATRIX}, {_GIVEN} " + " UNION ALL ".join(f"SELECT {c}::DOUBLE AS threshold, count(*) FILTER (WHERE p >= {c}::DOUBLE) AS flagged, (count(*) FILTER (WHERE p >= {c}::DOUBLE)) / count(*) AS share, count(*) FILTER (WHERE p >= {c}::DOUBLE AND is_gold) AS gold_recovered FROM given" for c in CUTS),
    "posterior": f"{_MATRIX}, {_GIVEN} SELECT l_orderkey, l_linenumber, round(p, 9) AS prob_security, label FROM given",
    "most_likely": f"{_MATRIX}, {_GIVEN} SELECT DISTINCT l_orderkey, l_linenumber, round(p, 9) AS prob_security FROM given WHERE label = 1 ORDER BY prob_security DESC, l_orderkey, l_linenumber LIMIT 15",
    "label_extremes": f"{_MATRIX}, {_GIVEN} SELECT label, count(*) AS n, min(round(p, 9)) AS least, max(round(p, 9)) AS most FROM given GROUP BY 1",
    "label_distribution": f"{_MATRIX} SELECT mv_label AS label, count(*) AS n, count(*) / (SELECT count(*) FROM m) AS share FROM m GROUP BY 1",
    "gold_recall": f"{_MATRIX} SELECT count(*) FILTER (WHERE is_gold) AS gold, count(*) FILTER (WHERE is_gold AND mv_label = 1) AS recovered, (count(*) FILTER (WHERE is_gold AND mv_label = 1)) / (count(*) FILTER (WHERE is_gold)) AS recall, count(*) FILTER (WHERE NOT is_gold AND mv_label = 1) AS extra FROM m WHERE mv_label <> -1",
    "cofire": f"{_MATRIX}, r AS (SELECT *, row_number() OVER () AS k FROM vm), f AS (SELECT k, unnest(list_filter([{_YES}], lambda x: x IS NOT NULL)) AS lf FROM r) SELECT a.lf AS a, b.lf AS b, count(*) AS n FROM f a JOIN f b USING (k) WHERE a.lf <= b.lf GROUP BY 1, 2",
    "vetoes": f"{_MATRIX}, f AS (SELECT y, unnest(list_filter([{_NO}], lambda x: x IS NOT NULL)) AS lf FROM m WHERE is_gold) SELECT lf, count(*) AS n, count(*) FILTER (WHERE y = 0) AS lone FROM f GROUP BY 1",
    "by_repo": f"{_MATRIX} SELECT repo, count(*) AS commits, count(*) FILTER (WHERE y + n > 0) AS any_vote, count(*) FILTER (WHERE y > 0) AS any_positive, count(*) FILTER (WHERE is_gold) AS gold, count(*) FILTER (WHERE mv_label = 1) AS flagged, round((count(*) FILTER (WHERE mv_label = 1)) * 100 / count(*), 2) AS flagged_percent FROM m GROUP BY 1",
    "gold_detail": f"{_MATRIX} SELECT l_orderkey, l_linenumber, array_to_string(list_filter([{_YES}], lambda x: x IS NOT NULL), ',') AS positives, array_to_string(list_filter([{_NO}], lambda x: x IS NOT NULL), ',') AS vetoes, mv_label FROM m WHERE is_gold",
    "conversion": f"{_MATRIX} SELECT least(y, 3)::INT AS n_positive, count(*) AS n, count(*) FILTER (WHERE mv_label = 1) AS labeled FROM m GROUP BY 1",
    "missed_gold": f"{_MATRIX} SELECT repo, count(*) AS n, count(*) FILTER (WHERE mv_label = -1) AS abstained, count(*) FILTER (WHERE n > 0) AS vetoed FROM m WHERE is_gold AND mv_label <> 1 GROUP BY 1",
    "url_parse": f"WITH {cves_cte()}, {links('exploded', 'cve_id, pos')} SELECT cve_id, pos::INT AS pos, owner, name, repo_key, kind, id, url FROM links",
    "nvd_records": f"WITH {cves_cte()} SELECT cve_id, published, last_modified, description, cvss_score, cvss_severity, array_to_string(cwes, ',') AS cwes, array_to_string(reference_urls, ' ') AS reference_urls, array_to_string(patch_urls, ' ') AS patch_urls FROM cves",
    "advisory_window": f"WITH {cves_cte()} SELECT cve_id, published, cvss_score FROM cves WHERE published::TIMESTAMP >= TIMESTAMP '1996-08-31 00:00:00' - INTERVAL 18 MONTH AND published::TIMESTAMP < TIMESTAMP '1996-08-31 00:00:00' AND cvss_score >= 2.5",
    "primary_repo": f"WITH {_CVE_LINKS}, {_PRIMARY} SELECT cve_id, primary_repo FROM primaries",
    "osv_fixes": f"WITH {cves_cte()}, {_FIXES} SELECT osv_id, repo_key, commit, source FROM osv_fixes",
    "cve_fixes": f"WITH {cves_cte()}, {_FIXES} SELECT cve_id, repo_key, commit, source FROM fixes",
    "cve_records": f"WITH {_CVE_LINKS}, {_FIXES}, {_PRIMARY} SELECT c.cve_id, coalesce((SELECT array_to_string(list_sort(list(DISTINCT repo_key)), ',') FROM links l WHERE l.cve_id = c.cve_id), '') AS github_repos, p.primary_repo, (SELECT count(*) FROM links l WHERE l.cve_id = c.cve_id AND kind IS NOT NULL) AS n_patch_refs, (SELECT count(*) FROM fixes f WHERE f.cve_id = c.cve_id) AS n_fixes FROM cves c LEFT JOIN primaries p USING (cve_id)",
    "repo_targets": f"WITH {_CVE_LINKS}, {_FIXES}, {_TARGETS}, lastc AS (SELECT repo_key, commit, max((published, cve_id)) AS top FROM edges JOIN cves USING (cve_id) WHERE commit IS NOT NULL GROUP BY 1, 2), maps AS (SELECT repo_key, string_agg(commit || '=' || top[2], ',' ORDER BY commit) AS commit_to_cve FROM lastc GROUP BY 1) SELECT repo_key, array_to_string(cve_ids, ',') AS cve_ids, array_to_string(fix_commits, ',') AS fix_commits, array_to_string(fix_prs, ',') AS fix_prs, coalesce(commit_to_cve, '') AS commit_to_cve FROM targets LEFT JOIN maps USING (repo_key)",
    "ranked_targets": f"WITH {_CVE_LINKS}, {_FIXES}, {_TARGETS} SELECT repo_key, len(fix_commits)::INT AS n_fixes, len(cve_ids)::INT AS n_cves FROM targets WHERE len(fix_commits) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25",
    "window_summary": f"WITH {_CVE_LINKS}, {_FIXES}, {_TARGETS} SELECT (SELECT count(*) FROM cves) AS scanned, (SELECT count(DISTINCT cve_id) FROM links) AS kept, (SELECT count(*) FROM targets) AS repos, (SELECT sum(len(fix_commits)) FROM targets)::BIGINT AS fix_commits",
    "cwe_counts": f"WITH {cves_cte()} SELECT cwe, count(*) AS n FROM (SELECT unnest(cwes) AS cwe FROM cves) GROUP BY 1",
    "reference_kinds": f"WITH {cves_cte()}, x AS (SELECT cve_id, pos, url, contains(url, '/advisories/GHSA-') AS page, row_number() OVER (PARTITION BY cve_id, url ORDER BY pos) AS k FROM exploded) SELECT cve_id, coalesce(string_agg(url, ' ' ORDER BY pos) FILTER (WHERE page), '') AS advisory_urls, coalesce(string_agg(url, ' ' ORDER BY pos) FILTER (WHERE NOT page), '') AS other_urls FROM x WHERE k = 1 GROUP BY 1",
    "git_log": f"WITH {commits_cte()} SELECT repo, sha, author_email, committer_date, subject, message, is_merge, n_parents::INT AS n_parents, len(files)::INT AS n_files, array_to_string(files, ',') AS files, (len(files) * (insertions % 50))::INT AS insertions, (len(files) * (deletions % 50))::INT AS deletions FROM commits WHERE id % 37 <> 3",
    "history_window": f"WITH {commits_cte()} SELECT repo, sha FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY committer_date DESC, sha) AS k FROM commits WHERE committer_date >= '2024-01-01T06:00:00' AND committer_date < '2025-01-01') WHERE k <= 20",
    "resolve_shas": f"{_ALL} SELECT cve_id, repo_key, commit, full_sha FROM resolved",
    "gold_flags": f"{_ALL} SELECT repo, sha, is_cve_fix, cve_id, all_cves, repo_cve_ids FROM golden",
    "distinct_commits": f"WITH {commits_cte()} SELECT DISTINCT repo, sha FROM commits",
    "repo_counts": f"{_ALL} SELECT repo, count(*) AS commits, count(*) FILTER (WHERE is_cve_fix) AS gold FROM golden GROUP BY 1",
    "backports": f"WITH {commits_cte()} SELECT repo, subject, count(*) AS n, min(author_date) AS first_date, string_agg(DISTINCT sha, ',' ORDER BY sha) AS shas, arg_min(sha, author_date || sha) AS representative FROM commits GROUP BY 1, 2",
    "backport_members": f"WITH {commits_cte()} SELECT sha, repo, first_value(sha) OVER (PARTITION BY repo, subject ORDER BY author_date, sha) AS representative FROM commits",
    "python_votes": f"{_MESSAGE} SELECT sha, {', '.join(f'{a} AS {b}, {a}' for a, b in (('lf_cve_id', 'py_cve_id'), ('lf_merge_commit', 'py_merge_commit'), ('lf_huge_diff', 'py_huge_diff'), ('lf_typo_or_style', 'py_style')))} FROM counted",
    "repo_view": f"{_STORED} SELECT repo, sha, subject, n_files, is_gold FROM stored WHERE repo = 'org/src1'",
    "hot_repo_view": f"{_STORED} SELECT repo, sha, subject, n_files, is_gold FROM stored WHERE repo = 'org/src0'",
    "stored_distinct": f"{_STORED} SELECT DISTINCT repo, sha FROM stored",
    "stored_counts": f"{_STORED} SELECT repo, count(*) AS commits, count(*) FILTER (WHERE is_gold) AS gold FROM stored GROUP BY 1",
    "dump_round_trip": f"WITH {commits_cte()} SELECT repo, sha, parents, author_email, author_date, subject, md5(body) AS body, array_to_string(files, ',') AS files, CASE WHEN n_files = 0 THEN 0 ELSE insertions END AS insertions, CASE WHEN n_files = 0 THEN 0 ELSE deletions END AS deletions, md5(diff_text) AS patch FROM commits",
    "gold_audit": f"{_ALL} SELECT g.repo, g.cve_id, any_value(c.cvss_severity) AS cvss_severity, array_to_string(any_value(c.cwes), ',') AS cwes, count(*) AS n_commits FROM golden g JOIN cves c USING (cve_id) WHERE is_cve_fix GROUP BY 1, 2",
    "unattributed_cves": f"{_ALL}, mined AS (SELECT * FROM every7 WHERE repo_key IN (SELECT lower(repo) FROM commits) AND cve_id NOT IN (SELECT cve_id FROM golden WHERE is_cve_fix)) SELECT cve_id, CASE WHEN max((c.sha IS NOT NULL)::INT) = 1 THEN 'masked' ELSE 'unreachable' END AS state FROM mined m LEFT JOIN commits c ON lower(c.repo) = m.repo_key AND starts_with(c.sha, m.commit) GROUP BY 1",
    "flat_gold": f"{_ALL} SELECT repo, author_date, sha, cve_id, subject FROM golden WHERE is_cve_fix",
    "cwe_of_gold": f"{_ALL} SELECT cwe, count(*) AS n FROM (SELECT unnest(c.cwes) AS cwe FROM golden g JOIN cves c USING (cve_id) WHERE is_cve_fix) GROUP BY 1",
}
SQL["target_parts"] = SQL["repo_targets"]
SQL |= {"landed_nvd": SQL["nvd_records"], "cve_lines": SQL["nvd_records"], "landed_osv": SQL["osv_fixes"]}
SQL["commits_parquet"] = SQL["commits_json"] = f"""{_ALL} SELECT repo, sha, author_date, subject, n_files::INT AS n_files, is_merge, md5(message) AS message, array_to_string(files, ',') AS files, is_cve_fix, cve_id, repo_cve_ids FROM golden"""
SQL["reread_sample"] = f"{_WITH}, {_STRATA} SELECT sha, repo, stratum, md5(diff_text) AS patch FROM drawn"
SQL["reread_citations"] = f"""SELECT c.sha, coalesce(x.patch_cites_advisory, false) AS patch_cites_advisory, coalesce(x.patch_cites_fix_commit, false) AS patch_cites_fix_commit
  FROM (WITH {commits_cte()} SELECT sha FROM commits) c LEFT JOIN ({SQL["citations"]}) x ON x.sha = c.sha"""
