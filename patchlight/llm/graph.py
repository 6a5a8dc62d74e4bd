"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import saved


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """``edges``, written, with their number and a digest of them, observed as they are written."""
    seen = Observation()
    now = saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("mark")), "edges")
    return now, (seen.get["n"], seen.get["mark"])


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Of each row several edges (``u``, ``v``), but none from a node to itself."""
    edges = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return rows.select(F.explode(edges).alias("e")).select("e.u", "e.v").filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """For edges ``a``, ``b`` (longs): each node with the smallest node that it reaches, ``node``, ``root``.

    Rounds of hooking larger neighbours, then smaller ones, to each node's smallest neighbour; every round
    is written, and the number of rounds grows with the logarithm of the edges. No neighbour list is gathered.
    """
    now, mark = _marked(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = (0, 0)
    while mark != before:
        before = mark
        both = _each(now, ("u", "v"), ("v", "u")).select(F.col("u").alias("x"), F.col("v").alias("y"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # Larger neighbours, and the node itself, go to the smallest of a node's neighbourhood.
        near = both.join(least, "x").withColumn("y", F.greatest("x", "y"))
        large = saved(_each(near, ("x", "m"), ("y", "m")).distinct(), "hooked-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now, mark = _marked(_each(large.join(least, "u"), ("u", "m"), ("v", "m")).distinct())
    if not mark[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return saved(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components")
