"""Benchmark decontamination: size-partitioned MinHash search for short items inside long texts, verified exactly.

Items fall into classes by their number of shingles, up to 8, 16, 32 and so on. For the class up to ``u``, a text is cut into
blocks of ``u`` shingles, and every two neighbouring blocks form a window, so any run of the text as long as an item of the
class lies in one window of at most twice the class's size. An item has more than half its class's size of shingles, or over three in the
smallest class; if eight tenths of it are in one run of the text, its Jaccard similarity with the window is over a sixth, however long
the text is. With one row a band, any of ``permutations`` equal minima makes a candidate, so such an item is missed with a
chance below ``(5 / 6) ** permutations`` (1e-5), and one that is scattered over a text with a chance that grows with its pieces. An item of up to
three shingles must be there whole, so its least shingle finds it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as vt
from .bits import build_filter
from .storage import saved

SHINGLE_WORDS = 5
LEAST_CONTAINMENT = 0.8
PERMUTATIONS = 64
SMALLEST_CLASS = 8
#: Items of at most so many shingles are looked up by one of them.
EXACT = 3


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = (vt.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (vt.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)
    return a, b


def size_class(n: int) -> int:
    """The smallest class that holds a set of n shingles, as a power of two."""
    return max(SMALLEST_CLASS, 1 << max(int(n) - 1, 0).bit_length())


def band_keys(values: np.ndarray, which: int, size: int) -> np.ndarray:
    """Class, permutation and minimum in one 64-bit key."""
    return values.astype(np.uint64) | np.uint64(which << 32 | size.bit_length() << 48)


def item_keys(hashes: np.ndarray, permutations: int, least: float) -> np.ndarray:
    """The keys of one item's set; of one that must be found whole, its least shingle."""
    if len(hashes) <= EXACT and least * len(hashes) > len(hashes) - 1:
        return hashes.min(keepdims=True)
    a, b = _coefficients(permutations)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    return np.array([band_keys((x * a[k] + b[k]).min(keepdims=True), k, size_class(len(hashes)))[0] for k in range(permutations)], np.uint64)


def window_keys(hashes: np.ndarray, where: np.ndarray, sizes: list[int], permutations: int, passes) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of all texts, those keys that pass, and the text of each."""
    a, b = _coefficients(permutations)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    counts = np.diff(where)
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    small = -(-counts // SMALLEST_CLASS)
    first = np.cumsum(small) - small
    of = np.repeat(np.arange(len(counts)), small)
    starts = where[:-1][of] + (np.arange(len(of)) - first[of]) * SMALLEST_CLASS
    plans = []
    for size in sizes:
        each = -(-small // (size // SMALLEST_CLASS))
        text = np.repeat(np.arange(len(counts)), each)
        begin = first[text] + (np.arange(len(text)) - (np.cumsum(each) - each)[text]) * (size // SMALLEST_CLASS)
        plans.append((size, begin, text, np.append(text[1:] == text[:-1], False)))
    at = np.flatnonzero(passes(hashes))
    keys, texts = [hashes[at]], [np.searchsorted(where, at, "right") - 1]
    for k in range(permutations):
        least = np.minimum.reduceat(x * a[k] + b[k], starts)
        for size, begin, text, has_next in plans:
            block = np.minimum.reduceat(least, begin) if size > SMALLEST_CLASS else least
            window = block.copy()
            window[:-1] = np.where(has_next[:-1], np.minimum(block[:-1], block[1:]), block[:-1])
            key = band_keys(window, k, size)
            at = np.flatnonzero(passes(key))
            keys.append(key[at])
            texts.append(text[at])
    return np.concatenate(keys), np.concatenate(texts)


def item_shingles(items: DataFrame, shingle_words: int) -> DataFrame:
    """Distinct shingles of each item: ``item_id``, ``h``. Rows with one item_id form one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(1))
            h, where = vt.shingles(*vt.words(data, offsets), shingle_words)
            of = np.repeat(np.arange(batch.num_rows), np.diff(where))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(vt.signed(h))], ["item_id", "h"])

    return items.filter(F.col("item_id").isNotNull()).select("item_id", "text").mapInArrow(run, "item_id bigint, h bigint").distinct()


def contained_items(docs: DataFrame, items: DataFrame, *, least: float = LEAST_CONTAINMENT, shingle_words: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """Items found in documents: ``doc_id``, ``item_id``, ``n_shared``, ``n_item`` and ``containment``, at least ``least``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``. Candidates come from MinHash; for them the item's
    distinct shingles that the whole document holds are counted exactly. An item of fewer words than a shingle is one shingle,
    found only in texts that are just that; an item without words is found nowhere.

    Null texts are empty; null ids are left out; rows that repeat an id count as one document, or item. Empty tables give
    an empty result. The items' keys and shingles reach the tasks as filters of fixed size; what passes meets them in joins.
    """
    spark = docs.sparkSession
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    shingles = saved(item_shingles(items, shingle_words), "item-shingles")

    def sketch(pdf: pd.DataFrame) -> pd.DataFrame:
        found = item_keys(pdf["h"].to_numpy().view(np.uint64), permutations, least)
        return pd.DataFrame({"item_id": pdf["item_id"].iloc[0], "key": vt.signed(found), "n_item": np.int64(len(pdf))})

    sketches = saved(shingles.groupBy("item_id").applyInPandas(sketch, "item_id bigint, key bigint, n_item bigint"), "item-sketches")
    largest = sketches.agg(F.max("n_item")).first()[0]
    sizes = [1 << k for k in range(SMALLEST_CLASS.bit_length() - 1, size_class(largest or 1).bit_length())]
    sent = spark.sparkContext.broadcast((build_filter(sketches, "key"), sizes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = sent.value
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(1))
            for i, j in vt.slices(offsets):
                h, where = vt.shingles(*vt.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), shingle_words)
                keys, of = window_keys(h, where, sizes, permutations, known.passes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + i)), pa.array(vt.signed(keys))], ["doc_id", "key"])

    hits = texts.mapInArrow(search, "doc_id bigint, key bigint")
    pairs = saved(hits.join(sketches.select("key", "item_id"), "key").select("doc_id", "item_id").distinct(), "contamination-pairs")
    suspects = pairs.select("doc_id").distinct()
    verify = spark.sparkContext.broadcast((build_filter(suspects, "doc_id"), build_filter(shingles, "h")))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = verify.value
        for batch in batches:
            batch = batch.filter(pa.array(wanted.passes(batch.column(0).to_numpy())))
            data, offsets = vt.text_bytes(batch.column(1))
            for i, j in vt.slices(offsets):
                h, where = vt.shingles(*vt.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), shingle_words)
                at = np.flatnonzero(known.passes(h))
                of = np.searchsorted(where, at, "right") - 1 + i
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(vt.signed(h[at]))], ["doc_id", "h"])

    held = texts.mapInArrow(exact, "doc_id bigint, h bigint").distinct()
    # Each pair brings its item's shingles, so a shingle that many texts and items hold joins none but candidates.
    sized = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    met = pairs.join(shingles, "item_id").join(held, ["doc_id", "h"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared")).join(sized, "item_id")
    found = met.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= least)
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")
