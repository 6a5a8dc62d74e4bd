"""Security advisories: records, links to repositories and fixes, and the index of repositories to mine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v

LINK = "struct<owner:string,name:string,repo_key:string,kind:string,id:string,url:string>"


def english(descriptions: Column) -> Column:
    return F.coalesce(F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"], F.lit(""))


def best_cvss(metrics: Column) -> tuple[Column, Column]:
    """Score and severity: the newest version that has an entry, its primary entries first."""
    entry = F.coalesce(*[F.get(F.concat(F.filter(metrics[m], lambda x: x["type"] == "Primary"), F.filter(metrics[m], lambda x: ~x["type"].eqNullSafe("Primary"))), F.lit(0)) for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    return entry["cvssData"]["baseScore"], F.coalesce(entry["cvssData"]["baseSeverity"], entry["baseSeverity"])


def cwe_list(weaknesses: Column) -> Column:
    values = F.flatten(F.transform(weaknesses, lambda w: F.transform(w["description"], lambda d: d["value"])))
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.startswith("CWE-"))))


def nvd_records(pages: DataFrame) -> DataFrame:
    """One row per advisory of landed pages (``vulnerabilities``): id, dates, description, score, severity, CWEs and references."""
    items = pages.select(F.explode("vulnerabilities").alias("x")).select("x.cve.*")
    score, severity = best_cvss(F.col("metrics"))
    refs = F.col("references")
    return items.select(
        F.col("id").alias("cve_id"),
        "published",
        F.col("lastModified").alias("last_modified"),
        english(F.col("descriptions")).alias("description"),
        score.alias("cvss_score"),
        severity.alias("cvss_severity"),
        cwe_list(F.col("weaknesses")).alias("cwes"),
        F.transform(refs, lambda r: r["url"]).alias("reference_urls"),
        F.transform(F.filter(refs, lambda r: F.array_contains(r["tags"], "Patch")), lambda r: r["url"]).alias("patch_urls"),
    )


def in_window(cves: DataFrame, end: str, months: int, least_score: float | None = None) -> DataFrame:
    """Advisories of so many calendar months before ``end`` (not included), the day clamped to a month's end; without a score none passes a minimum."""
    stop = F.to_timestamp(F.lit(end))
    published = F.to_timestamp("published")
    kept = cves.filter((published >= stop - F.make_ym_interval(F.lit(0), F.lit(months))) & (published < stop))
    return kept if least_score is None else kept.filter(F.col("cvss_score") >= least_score)


def parse_link(url: Column) -> Column:
    """Owner, name, repo_key, kind and id that a code host's URL names; null for other URLs. kind is null for a plain repository."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    # A trailing ;part belongs to the last segment's parameters, not to the path.
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r";[^/]*\z", "")
    parts = F.filter(F.split(path, "/", -1), lambda p: p != "")
    api = host == "api.github.com"
    usable = host.isin(v.GITHUB_HOSTS) & (~api | ((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "repos")))
    at = lambda k: F.get(parts, F.when(api, k + 1).otherwise(k))
    name = F.regexp_replace(F.regexp_replace(F.trim(at(1)), r"\.git$", ""), r"""[.,);\]'"]+$""", "")
    owner, section, value = at(0), at(2), at(3)
    known = usable & name.isNotNull() & (name != "") & ~F.lower(owner).isin(v.RESERVED_OWNERS)
    sha = section.isin("commit", "commits") & F.lower(value).rlike(r"\A[0-9a-f]{7,40}\z")
    tag = (section == "releases") & (value == "tag") & at(4).isNotNull()
    kind = F.when(sha, "commit").when((section == "pull") & value.rlike(r"\A[0-9]+\z"), "pull").when((section == "compare") & value.isNotNull(), "compare").when(tag, "release")
    ident = F.when(sha, F.lower(value)).when(tag, at(4)).when(kind.isNotNull(), value)
    key = F.lower(F.concat(owner, F.lit("/"), name))
    return F.when(known, F.struct(owner.alias("owner"), name.alias("name"), key.alias("repo_key"), kind.alias("kind"), ident.alias("id"), url.alias("url"))).cast(LINK)


def cve_links(cves: DataFrame) -> DataFrame:
    """One row per reference that names a repository: ``cve_id``, ``pos`` and the parsed link."""
    refs = cves.select("cve_id", F.posexplode("reference_urls").alias("pos", "url"))
    return refs.withColumn("x", parse_link(F.col("url"))).filter(F.col("x").isNotNull()).select("cve_id", "pos", "x.*")


def primary_repos(links: DataFrame) -> DataFrame:
    """Per CVE ``primary_repo``: the repository with most patch links (the first seen wins a tie), else the only one, else null."""
    counts = links.groupBy("cve_id", "repo_key").agg(F.count("kind").alias("patches"), F.min(F.when(F.col("kind").isNotNull(), F.col("pos"))).alias("first"), F.min(F.struct("pos", F.concat("owner", F.lit("/"), "name").alias("full_name"))).alias("shown"))
    best = F.max(F.when(F.col("patches") > 0, F.struct("patches", (-F.col("first")).alias("early"), "repo_key")))
    return counts.groupBy("cve_id").agg(best["repo_key"].alias("patched"), F.count(F.lit(1)).alias("n"), F.min("repo_key").alias("any")).select("cve_id", F.coalesce("patched", F.when(F.col("n") == 1, F.col("any"))).alias("primary_repo"))


def osv_fixes(osv: DataFrame) -> DataFrame:
    """Fixing commits that advisories name, by range events or by reference: ``osv_id``, ``repo_key``, ``commit``, ``source``; the first of equals stays."""
    ranges = osv.select("id", F.explode("affected").alias("a")).select("id", F.explode("a.ranges").alias("r")).filter("r.type = 'GIT'")
    events = ranges.select("id", parse_link(F.col("r.repo"))["repo_key"].alias("repo_key"), F.explode("r.events").alias("e")).filter("repo_key is not null and e.fixed <> ''")
    ranged = events.select(F.col("id").alias("osv_id"), "repo_key", F.lower("e.fixed").alias("commit"), F.lit("range").alias("source"))
    refs = osv.select("id", F.explode("references").alias("r")).filter("r.type in ('FIX', 'ADVISORY')").select("id", parse_link(F.col("r.url")).alias("x")).filter("x.kind = 'commit'")
    linked = refs.select(F.col("id").alias("osv_id"), "x.repo_key", F.col("x.id").alias("commit"), F.lit("reference").alias("source"))
    both = ranged.unionByName(linked)
    # "range" sorts before "reference", as it comes first.
    return both.groupBy("osv_id", "repo_key", "commit").agg(F.min("source").alias("source"))


def fixes_of_cves(osv: DataFrame, cves: DataFrame) -> DataFrame:
    """Fixes attached to CVEs by the advisory's id or an alias: ``cve_id``, ``repo_key``, ``commit``, ``source``."""
    names = osv.select("id", F.explode(F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("cve_id"))
    return osv_fixes(osv).join(names.withColumnRenamed("id", "osv_id"), "osv_id").join(cves.select("cve_id"), "cve_id", "left_semi").select("cve_id", "repo_key", "commit", "source").distinct()


def cve_records(cves: DataFrame, links: DataFrame, fixes: DataFrame) -> DataFrame:
    """The normalized record: adds repositories by key, the primary one, patch links in order, and fixes."""
    repos = links.groupBy("cve_id").agg(F.array_sort(F.collect_set("repo_key")).alias("github_repos"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("pos", "repo_key", "kind", "id", "url")))).alias("patch_refs"))
    own = fixes.groupBy("cve_id").agg(F.array_sort(F.collect_set(F.struct("repo_key", "commit", "source"))).alias("osv_fixes"))
    out = cves.join(repos, "cve_id", "left").join(primary_repos(links), "cve_id", "left").join(own, "cve_id", "left")
    return out.withColumn("github_repos", F.coalesce("github_repos", F.array().cast("array<string>")))


def _edges(links: DataFrame, fixes: DataFrame) -> DataFrame:
    """Which CVE goes to which repository, by which commit or pull request, if any: ``repo_key``, ``cve_id``, ``commit``, ``pr``."""
    primary = primary_repos(links)
    spread = links.select("cve_id", "repo_key").distinct().join(primary, "cve_id").filter(F.col("primary_repo").isNull() | (F.col("primary_repo") == F.col("repo_key"))).select("repo_key", "cve_id")
    none = F.lit(None).cast("string")
    edges = spread.select("repo_key", "cve_id", none.alias("commit"), none.alias("pr"))
    patched = links.filter("kind in ('commit', 'pull')").select("repo_key", "cve_id", F.when(F.col("kind") == "commit", F.col("id")).alias("commit"), F.when(F.col("kind") == "pull", F.col("id")).alias("pr"))
    return edges.unionByName(patched).unionByName(fixes.select("repo_key", "cve_id", "commit", none.alias("pr")))


def repo_cves(links: DataFrame, fixes: DataFrame) -> DataFrame:
    """The CVEs that ``repo_targets`` lists with each repository, a row each: ``repo_key``, ``cve_id``."""
    return _edges(links, fixes).select("repo_key", "cve_id").filter("cve_id is not null").distinct()


def repo_targets(links: DataFrame, fixes: DataFrame, published: DataFrame) -> DataFrame:
    """Repositories to mine: ``repo_key``, sorted ``cve_ids``, ``fix_commits``, ``fix_prs`` and the CVE of each commit.

    A CVE goes to its primary repository, or to all if it has none; patch links and fixes also bring their own. If several CVEs
    share a commit the latest published one is its CVE. ``published`` has ``cve_id``, ``published``.
    """
    every = _edges(links, fixes)
    sets = every.groupBy("repo_key").agg(*[F.array_sort(F.collect_set(c)).alias(n) for c, n in (("cve_id", "cve_ids"), ("commit", "fix_commits"), ("pr", "fix_prs"))])
    last = every.filter("commit is not null").join(published, "cve_id").groupBy("repo_key", "commit").agg(F.max_by("cve_id", F.struct("published", "cve_id")).alias("cve_id"))
    maps = last.groupBy("repo_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("commit", "cve_id")))).alias("commit_to_cve"))
    return sets.join(maps, "repo_key", "left")


def ranked_targets(targets: DataFrame, least_fixes: int, n: int) -> DataFrame:
    """The first ``n`` repositories with enough fix commits: most fixes, then most CVEs, then name."""
    sized = targets.select("repo_key", F.size("fix_commits").alias("n_fixes"), F.size("cve_ids").alias("n_cves")).filter(F.col("n_fixes") >= least_fixes)
    return sized.orderBy(F.desc("n_fixes"), F.desc("n_cves"), "repo_key").limit(n)


def window_summary(scanned: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: advisories scanned, those kept (with a repository), repositories, and fix commits."""
    kept = links.agg(F.count_distinct("cve_id").alias("kept"))
    sums = targets.agg(F.count(F.lit(1)).alias("repos"), F.coalesce(F.sum(F.size("fix_commits")), F.lit(0)).alias("fix_commits"))
    return scanned.agg(F.count(F.lit(1)).alias("scanned")).join(kept).join(sums)


def cwe_counts(cves: DataFrame) -> DataFrame:
    return cves.select(F.explode("cwes").alias("cwe")).groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))


def reference_kinds(cves: DataFrame) -> DataFrame:
    """Advisory pages of a CVE and its other references, both without repeats and in order."""
    pages = F.array_distinct(F.filter("reference_urls", lambda u: u.contains("/advisories/GHSA-")))
    return cves.select("cve_id", pages.alias("advisory_urls"), F.array_except("reference_urls", pages).alias("other_urls"))
