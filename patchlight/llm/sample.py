"""Bounded samples of labelled documents, and names that no column has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS = 16


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, with as many underscores before it as make it different from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drawn(labelled: DataFrame, label: str, most: int) -> DataFrame:
    """Of each label at most ``most`` rows of ``labelled`` (``doc_id`` and the label), in the order of a hash of the id.

    Counts by the leading bits of the hash say how far each label's order is needed, so only about ``most`` rows of it are sorted. One row for
    each label is broadcast: the model that is trained on the sample holds far more for each.
    """
    rows = labelled.select("doc_id", label, F.xxhash64("doc_id").alias("draw")).withColumn("head", F.shiftrightunsigned("draw", 64 - _BITS))
    upto = F.sum("n").over(Window.partitionBy(label).orderBy("head"))
    counts = rows.groupBy(label, "head").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    last = counts.groupBy(label).agg(F.min(F.when(F.col("upto") >= most, F.col("head"))).alias("last"))
    near = rows.join(F.broadcast(last), label).filter(F.col("last").isNull() | (F.col("head") <= F.col("last")))
    place = F.row_number().over(Window.partitionBy(label).orderBy("head", "draw", "doc_id"))
    return near.withColumn("k", place).filter(F.col("k") <= most).select("doc_id", label)
