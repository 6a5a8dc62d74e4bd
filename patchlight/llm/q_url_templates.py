"""op6: verdicts on the url of every page."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_templates import filter_urls, url_path

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number its path holds: bad if toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.try_to_number(F.nullif(F.regexp_extract(url_path(F.col("url")), r"([0-9]{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    of_page = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")
    return filter_urls(pages, of_page, RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"), "method")


#: The oracle spells out so many levels; no path of the given tables is deeper.
LEVELS = 6


def _sql() -> str:
    level = []
    for k in range(LEVELS):
        node = f"host, t[1:{k}]" if k else "host"
        new = f"list_concat(t[1:{k}], ['*'], t[{k + 2}:])" if k else "list_concat(['*'], t[2:])"
        level.append(f"w{k} AS (SELECT *, len(list_distinct(list(t[{k + 1}]) OVER (PARTITION BY {node}))) AS w FROM l{k}), l{k + 1} AS (SELECT host, shape, labelled, n_bad, CASE WHEN len(t) > {k} AND w > 8 THEN {new} ELSE t END AS t FROM w{k})")
    return rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
lab AS (
  SELECT page_id, bool_or(quality = 0 OR toxic = 1) AS bad
  FROM p JOIN labels ON doc_id = try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})', 1), '') AS BIGINT) GROUP BY 1),
seg AS (
  SELECT p.*, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS x FROM p),
cut AS (
  SELECT page_id, host, path, array_to_string(x, '/') AS shape, x FROM seg),
l0 AS (
  SELECT host, shape, any_value(x) AS t, count(bad) AS labelled, count(*) FILTER (WHERE bad) AS n_bad
  FROM cut LEFT JOIN lab USING (page_id) GROUP BY host, shape),
{", ".join(level)},
tree AS (
  SELECT *, array_to_string(t, '/') AS template, len(t) AS depth FROM l{LEVELS}),
branches AS (
  SELECT host, depth, template, sum(labelled) AS l, sum(n_bad) AS b FROM tree GROUP BY ALL),
near AS (
  SELECT *, sum(b) OVER w / nullif(sum(l) OVER w, 0) AS rate FROM branches WINDOW w AS (PARTITION BY host, depth)),
own AS (
  SELECT *, CASE WHEN coalesce(abs(b / nullif(l, 0) - rate) > 1.645 * sqrt(rate * (1 - rate) / nullif(l, 0)), false) THEN template END AS branch FROM near),
judged AS (
  SELECT host, template, depth, (sum(l) OVER w - sum(b) OVER w + 5.0::DOUBLE * coalesce((SELECT 1 - sum(b) / nullif(sum(l), 0) FROM branches), 1)) / (sum(l) OVER w + 5) AS purity
  FROM own WINDOW w AS (PARTITION BY host, depth, branch)),
ruled AS (
  SELECT *, host = 'com' OR ends_with(host, '.com') AS com, host = 'net' OR ends_with(host, '.net') AS net,
         host = 'example.com' OR ends_with(host, '.example.com') AS ex, host = 'www.example.com' OR ends_with(host, '.www.example.com') AS wex FROM cut),
rules AS (
  SELECT *, CASE WHEN wex AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN ex AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN net AND starts_with(path, '/es/') THEN 'net/es/' WHEN net AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN com AND starts_with(path, '/') THEN 'com/' END AS rule FROM ruled)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block' WHEN j.purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       j.template, round(j.purity, 9) AS purity, CASE WHEN j.purity < 0.5 THEN 'block' ELSE 'allow' END AS method
FROM rules r JOIN tree t ON t.host = r.host AND t.shape = r.shape
JOIN judged j ON j.host = t.host AND j.template = t.template AND j.depth = t.depth
"""


OP6_SQL = _sql()
