"""How filters interact: what each removes in every order in which they could be applied.

Documents are counted by the set of filters that they fail (a mask), so whatever follows depends on at most 2**k cells per part. All orders
are then visited by plain changes, each made of the one before by swapping two neighbours: only the two steps that were swapped are
worked out anew from the cells, and each filter's Shapley sum grows by what it removes in the order at hand.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import unused
from .storage import saved

#: k filters have k! orders, each of which has k rows in the result.
MOST_FILTERS = 8


def plain_changes(k: int) -> Iterator[int]:
    """The places ``i`` at which to swap ``i`` and ``i + 1`` so that all orders of ``k`` things are met, each once, after the first."""
    order, way = list(range(k)), [-1] * k
    while True:
        movable = [(x, i) for i, x in enumerate(order) if 0 <= i + way[x] < k and order[i + way[x]] < x]
        if not movable:
            return
        x, i = max(movable)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        yield min(i, j)
        for y in range(x + 1, k):
            way[y] = -way[y]


def walk(k: int, masks: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """All orders of ``k`` filters over the cells of one part; ``counts`` has a row for each mask, documents first, then other measures.

    Gives the orders, and by order, step and measure what is removed, by order and step what had failed the filter but gone before,
    and by filter what it removes in all orders together.
    """
    fails = (masks[:, None] >> np.arange(k) & 1).astype(bool)
    orders, removed, redundant, shapley = [], [], [], np.zeros(k, np.int64)

    def step(before: int, f: int) -> tuple[np.ndarray, int]:
        gone = (masks & before) != 0
        return counts[fails[:, f] & ~gone].sum(axis=0), int(counts[fails[:, f] & gone, 0].sum())

    order, at = list(range(k)), []
    for i in range(k):
        at.append(step(sum(1 << f for f in order[:i]), i))
    swaps = plain_changes(k)
    while True:
        orders.append(tuple(order))
        removed.append([x for x, _ in at])
        redundant.append([x for _, x in at])
        shapley[order] += [int(x[0]) for x, _ in at]
        if (i := next(swaps, None)) is None:
            return orders, np.array(removed, np.int64), np.array(redundant, np.int64), shapley
        before = sum(1 << f for f in order[:i])
        order[i], order[i + 1] = order[i + 1], order[i]
        at[i], at[i + 1] = step(before, order[i]), step(before | 1 << order[i], order[i + 1])


def cells(docs: DataFrame, part: str, filters: list[str], measures: list[str]) -> DataFrame:
    """Documents, and those of each measure, by part and set of failed filters: ``part``, ``mask``, ``n`` and the measures."""
    bit = [F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)]
    mask = sum(bit[1:], bit[0])
    return docs.groupBy(F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(m).alias(m) for m in measures])


def audit(docs: DataFrame, part: str, filters: Mapping[str, str], measures: list[str]) -> DataFrame:
    """One row for each part of ``docs``, order of the filters and step.

    ``filters`` names boolean columns (whether a document fails; null: it doesn't) by one letter each, ``measures`` are boolean columns of
    which the lost documents are counted. A null ``part`` is the empty string; repeated rows count as often as they occur; an empty table
    has no parts and gives no rows. Columns of other names are ignored.
    """
    names, k = list(filters), len(filters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters are needed")
    counted = cells(docs, part, list(filters.values()), measures)
    rows = counted.groupBy("part").agg(F.sum("n").alias("all"), F.collect_list(F.struct("mask", "n", *measures)).alias("cells"))
    lost = [f"{m}_lost" for m in measures]
    longs = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, total, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                masks = np.array([c["mask"] for c in held], np.int64)
                counts = np.array([[c["n"], *(c[m] for m in measures)] for c in held], np.int64)
                orders, removed, redundant, shapley = walk(k, masks, counts)
                alone = np.array([counts[masks == 1 << f, 0].sum() for f in range(k)], np.int64)
                flat = np.array(orders).ravel()
                each = {
                    "kept": (total - np.cumsum(removed[:, :, 0], axis=1)).ravel(),
                    "removed": removed[:, :, 0].ravel(),
                    "redundant": redundant.ravel(),
                    "unique_fails": alone[flat],
                    **{name: removed[:, :, 1 + j].ravel() for j, name in enumerate(lost)},
                    "shapley": shapley[flat],
                }
                words = np.repeat(["".join(names[f] for f in o) for o in orders], k)
                steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(flat), pa.string()), pa.array(words, pa.string()), pa.array(steps), *(pa.array(each[c]) for c in longs)], ["part", "filter_order", "step", *longs])

    return rows.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} bigint' for c in longs)}")


def repeats(docs: DataFrame, name: str, *, id_col: str = "doc_id", digest_col: str = "digest") -> DataFrame:
    """Adds to ``docs`` whether a row of a smaller id has the same digest, as the boolean column ``name``.

    The least id of each digest is found by partial minima and met by digest and id together, so copies of one text aren't one task's. A row
    without an id repeats none; rows of the same least id don't repeat each other.
    """
    least, at = unused("least", docs.columns), unused("at", docs.columns)
    firsts = docs.groupBy(F.col(digest_col).alias(at)).agg(F.min(id_col).alias(least))
    met = docs.join(firsts, (F.col(digest_col) == F.col(at)) & (F.col(id_col) == F.col(least)), "left")
    return met.select(*docs.columns, (F.col(id_col).isNotNull() & F.col(least).isNull()).alias(name))


def text_failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id``, ``part`` and whether each whole text is short, poor in distinct words, loud, holds symbols or repeats a smaller id's.

    A null text is empty; so null and empty texts repeat each other. Texts are read once, for what is written here.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(part_col).alias("part"), text.alias("text"), words.alias("words"))
    narrow = rows.select(
        "doc_id",
        "part",
        (F.size("words") < 100).alias("short"),
        (100 * F.size(F.array_distinct("words")) < 80 * F.size("words")).alias("poor"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.char_length("text")).alias("loud"),
        F.col("text").rlike("[#$%&*|]").alias("symbols"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    return repeats(saved(narrow, "filter-audit"), "copy").drop("digest")
