"""Mixing sources to target weights by capped water-filling, with seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sample import unused
from .storage import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Of the seeded 32-bit draw, the leading bits that name a bucket of a source's documents.
BUCKET_BITS = 12
#: Sources of one range of an order of all of them, on average.
RANGE_ROWS = 1 << 16
#: Sources are broadcast if their rows take no more than this; more of them meet the documents in joins.
FEW_BYTES = 1 << 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _before(rows: DataFrame, parts: int, order: list[Column], values: Sequence[str]) -> DataFrame:
    """Adds to each row the sums of ``values`` over all rows before it in ``order``, as ``before_<value>``.

    Rows are dealt out by ranges of the order, so a task sums its own range; only a row per range meets in one task.
    """
    dealt = saved(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values])
    starts = sums.select(F.col("__part").alias("__of"), *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(starts, F.col("__part") == F.col("__of"))
    return met.select(*rows.columns, *[(F.col(f"__{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"before_{v}") for v in values])


def targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """Water-filling over one row per source (``source``, ``source_size``; a written table, as it is read several times): adds ``target``.

    Sources in code point order, null last, take the weights in turn. A target is ``level * weight``,
    or the cap of ``epochs`` times the size where that is less; the level is the one at which the targets
    sum to the whole. It follows from the sources sorted by cap over weight: those below the level are
    clamped, and what they leave is shared by weight among the rest. Both orders are met by ranges, RANGE_ROWS sources each.
    """
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("size")).first()
    parts = max(1, -(-int(whole["n"]) // RANGE_ROWS))
    ranked = _before(sizes.withColumn("one", F.lit(1).cast("long")), parts, [F.col("source").asc_nulls_last()], ["one"]).withColumnRenamed("before_one", "rank").drop("one")
    cases = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", cases.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    weighed = _before(weighed.withColumn("ratio", F.col("cap") / F.col("weight")), parts, [F.col("ratio").asc(), F.col("rank").asc()], ["cap", "weight"])
    weighed = saved(weighed, "mix-weights")
    all_weights = weighed.agg(F.sum("weight")).first()[0] or 0
    level = (F.lit(int(whole["size"])) - F.col("before_cap")) / (F.lit(int(all_weights)) - F.col("before_weight"))
    # The first source that its level leaves unclamped sets the level of all that follow it.
    free = weighed.withColumn("level", level).filter(F.col("cap") >= F.col("level") * F.col("weight"))
    first = free.agg(F.min(F.struct("ratio", "rank", "level")).alias("x")).first()["x"]
    reached = F.lit(first["level"] if first else None).cast("double")
    return weighed.select("source", "source_size", F.least(F.col("cap").cast("double"), reached * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: ``docs`` with ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    A source is repeated ``floor(target / source_size)`` times whole. For the fraction that remains, documents
    join in the order of a seeded draw until the words so far come nearest to the target, so a source's taken words
    miss it by at most half a document. Where a source's order is cut follows from sums by bucket of the draw and the rows of the one
    bucket that the cut falls in, so that no source is sorted by a single task. Each
    document is compared with its source's cut; no text moves for that unless the sources are too many to broadcast (``FEW_BYTES``).

    Documents of one id are drawn alike and follow each other by size, text and, if they are equal, by their place in ``docs``, so
    a cut that falls among them divides them too. Null text has size 0; null sources form one source, the last; an empty table
    gives an empty result. Columns of ``docs`` that have the names of the new ones are replaced. Reruns agree.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    kept = docs.drop(*[c for c in new if c in docs.columns])
    head, place = unused("head", kept.columns), unused("place", kept.columns)
    order = F.struct(draw.alias("draw"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("size"), F.xxhash64(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    sized = kept.withColumn("size", n_words(F.col(text_col))).withColumns({head: F.shiftright(draw, 32 - BUCKET_BITS), place: order})
    narrow = sized.select(F.col(source_col).alias("source"), F.col(head).alias("__bucket"), "size", F.col(place).alias("place"))
    buckets = saved(narrow.groupBy("source", "__bucket").agg(F.sum("size").alias("held")), "mix-buckets")
    goals = targets(saved(buckets.groupBy("source").agg(F.sum("held").cast("long").alias("source_size")), "mix-sizes"), weights, epochs)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = buckets.withColumn("upto", F.sum("held").over(upto)).alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
    # The first bucket that goes beyond the fraction; all before it are taken.
    beyond = F.min(F.when(F.col("upto") > F.col("part"), F.struct(F.col("__bucket"), (F.col("upto") - F.col("held")).alias("before"))))
    cuts = summed.groupBy("g.source", "source_size", "target", "whole", "part").agg(beyond.alias("cut"))
    cuts = cuts.select("source", "source_size", "target", "whole", "part", F.coalesce("cut.__bucket", F.lit(1 << BUCKET_BITS)).alias("last"), "cut.before")
    cuts = saved(cuts, "mix-sources")
    held = cuts.agg(F.coalesce(F.sum(64 + F.coalesce(F.octet_length("source"), F.lit(0))), F.lit(0))).first()[0]
    near = F.broadcast if held <= FEW_BYTES else lambda rows: rows
    met = narrow.alias("n").join(near(cuts.alias("c")), F.col("n.source").eqNullSafe(F.col("c.source")) & (F.col("n.__bucket") == F.col("c.last"))).select("c.source", "n.place", "n.size", "c.before", "c.part")
    inside = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    ends = met.withColumn("reached", reached).filter(F.col("reached") <= F.col("part")).groupBy("source").agg(F.max("place").alias("end"))
    cuts = cuts.alias("c").join(ends.alias("e"), F.col("c.source").eqNullSafe(F.col("e.source")), "left").select("c.*", "e.end")
    taken = sized.alias("d").join(near(cuts.alias("c")), F.col(f"d.`{source_col}`").eqNullSafe(F.col("c.source")))
    head, place = F.col(f"d.{head}"), F.col(f"d.{place}")
    more = (F.col("c.part") > 0) & ((head < F.col("c.last")) | ((head == F.col("c.last")) & F.coalesce(place <= F.col("c.end"), F.lit(False))))
    copies = (F.col("c.whole") + F.when(more, 1).otherwise(0)).cast("int")
    return taken.select(*[f"d.`{c}`" for c in kept.columns], "d.size", "c.source_size", "c.target", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"))
