"""URL filters: rules first, else a per-host tree of path templates judged by smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .storage import saved

#: A node with more distinct children has a wildcard in their place.
FANOUT = 8
#: A branch merges with its siblings' pool unless its rate of bad pages is this many standard errors away.
SAME_Z = 1.645
#: Pseudo-count of pages at the rate of all labelled pages, and the purity below which a template is rejected.
PRIOR_PAGES = 5.0
LEAST_PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], say: str) -> Column:
    """The longest fitting rule of (action, host, path): its text, or its action if ``say`` is "action". Null if none fits."""
    out = F.lit(None).cast("string")
    for action, its_host, its_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(its_path)
        out = F.when(fits, F.lit(action if say == "action" else its_host + its_path)).otherwise(out)
    return out


def path_shape(path: Column) -> Column:
    """The path's segments, those with a digit as ``*``, between slashes."""
    return F.array_join(F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s)), "/")


def template_tree(shapes: DataFrame) -> DataFrame:
    """Path shapes (``host``, ``shape``, counts) with their ``t``, the segments of the template that each falls under.

    From the host down, the children of a node with more than FANOUT distinct ones become a wildcard, which lets nodes further down meet. All
    nodes of all paths are counted at once; each shape then takes the wildcard that is nearest to its host, and those that took one
    are counted again below it. So rounds are as many as wildcards stand above each other, however long paths are. Each round is
    written, so that the plan of the next does not hold the plans of all before it.
    """
    now = saved(shapes.withColumns({"t": F.filter(F.split("shape", "/", -1), lambda s: s != ""), "after": F.lit(0)}), "url-shapes")
    done = None
    while True:
        places = F.when(F.col("after") < F.size("t"), F.sequence("after", F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
        node = lambda k: F.xxhash64(F.array_join(F.slice("t", 1, k), "/"))
        cells = now.select("host", "shape", F.explode(F.transform(places, lambda k: F.struct(k.alias("k"), node(k).alias("node"), F.get("t", k).alias("child")))).alias("c")).select("host", "shape", "c.*")
        cells = saved(cells, "url-nodes")
        wide = cells.groupBy("host", "k", "node").agg(F.count_distinct("child").alias("children")).filter(F.col("children") > FANOUT).drop("children")
        first = cells.join(wide, ["host", "k", "node"]).groupBy("host", "shape").agg(F.min("k").alias("k"))
        wild = F.concat(F.slice("t", 1, F.col("k")), F.array(F.lit("*")), F.slice("t", F.col("k") + 2, F.greatest(F.size("t") - (F.col("k") + 1), F.lit(0))))
        going = F.col("k").isNotNull()
        seen = Observation()
        met = now.join(first, ["host", "shape"], "left").withColumns({"going": going, "t": F.when(going, wild).otherwise(F.col("t")), "after": F.when(going, F.col("k") + 1).otherwise(F.col("after"))})
        level = saved(met.select(*now.columns, "going").observe(seen, F.count_if("going").alias("n")), "url-tree")
        ended = level.filter(~F.col("going")).drop("going", "after")
        done = ended if done is None else done.unionByName(ended)
        if not seen.get["n"]:
            return done
        now = level.filter("going").drop("going")


def template_verdicts(pages: DataFrame) -> DataFrame:
    """Verdicts of path shapes, from ``host``, ``shape`` and ``bad`` (boolean, null where a page has no label).

    Pages are counted by shape first; the tree, its wildcards and merges are made of those counts.
    """
    tree = template_tree(pages.groupBy("host", "shape").agg(F.count("bad").alias("labelled"), F.count_if("bad").alias("n_bad")))
    tree = tree.withColumns({"template": F.array_join("t", "/"), "depth": F.size("t")})
    branches = tree.groupBy("host", "depth", "template").agg(F.sum("labelled").alias("l"), F.sum("n_bad").alias("b"))
    pools = branches.groupBy("host", "depth").agg(F.sum("b").alias("pb"), F.sum("l").alias("pl"))
    near = branches.join(pools, ["host", "depth"])
    rate = F.col("pb") / F.when(F.col("pl") > 0, F.col("pl"))
    far = F.abs(F.col("b") / F.when(F.col("l") > 0, F.col("l")) - rate) > SAME_Z * F.sqrt(rate * (1 - rate) / F.when(F.col("l") > 0, F.col("l")))
    near = near.withColumn("own", F.coalesce(far, F.lit(False)))
    near = near.withColumn("branch", F.when(F.col("own"), F.col("template")))
    merged = near.groupBy("host", "depth", "branch").agg(F.sum("l").alias("ml"), F.sum("b").alias("mb"))
    base = branches.agg((1 - F.sum("b") / F.when(F.sum("l") > 0, F.sum("l"))).alias("base"))
    purity = (F.col("ml") - F.col("mb") + PRIOR_PAGES * F.coalesce("base", F.lit(1.0))) / (F.col("ml") + PRIOR_PAGES)
    judged = near.join(merged.withColumnsRenamed({"host": "mh", "depth": "md", "branch": "mbranch"}), (F.col("host") == F.col("mh")) & (F.col("depth") == F.col("md")) & F.col("branch").eqNullSafe(F.col("mbranch")))
    judged = judged.join(F.broadcast(base), how="cross").select("host", "template", "depth", purity.alias("purity"))
    return tree.select("host", "shape", "template", "depth").join(judged, ["host", "template", "depth"]).select("host", "shape", "template", "purity", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow").alias("method"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge each page: ``id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` and ``method``, the template's verdict, which a rule may overrule.

    ``labels`` (``page_id``, ``bad``) covers any part of the pages; if a page has several labels, one bad one decides.
    The longest fitting rule decides; where none fits, the page's template does. Templates: segments with a digit, and all
    children of a node with more than 8, become wildcards; branches of a host with equally many segments merge unless
    their rate of bad pages differs from the pool's; the merged branch's share of good labelled pages, smoothed with five
    pages at the overall share, must reach one half. Without labels all templates pass.

    A null url, or one without ``://``, has an empty host and path. Repeated rows are judged alike, an empty table gives an
    empty result, and other columns of the inputs are ignored.
    """
    at = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    cut = at.withColumn("shape", path_shape(F.col("path")))
    known = labels.filter(F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("of")).agg(F.bool_or("bad").alias("bad"))
    shapes = template_verdicts(cut.join(known, F.col("page_id") == F.col("of"), "left").select("host", "shape", "bad"))
    judged = cut.join(shapes, ["host", "shape"], "left")
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_of(host, path, rules, "action"), F.col("method"))
    return judged.select("page_id", "host", "path", rule_of(host, path, rules, "text").alias("rule"), verdict.alias("verdict"), "template", "purity", "method")
