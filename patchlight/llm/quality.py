"""Quality by ordinal regression: shared weights of hashed text features, and ordered thresholds between grades."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as vt
from .sample import drawn

BITS = 18
#: Words of more bytes also count by their first ones.
PREFIX = 5
_KINDS = vt.mix64(np.arange(1, 8, dtype=np.uint64))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>!?@^_~={}[]\\/"]] = True


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of the fit."""

    docs_each: int = 2500
    epochs: int = 12
    batch: int = 64
    rate: float = 0.1
    sparsity: float = 1e-3
    seed: int = 11


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature buckets of each text, one after another, and where each text's begin.

    Features are words, beginnings of longer words, and the shape of the text in steps: the shares of distinct words, of symbols
    and of capitals, and the mean length of words.
    """
    n = len(offsets) - 1
    hashes, of = vt.words(data, offsets)
    counts = np.diff(of)
    text = np.repeat(np.arange(n, dtype=np.uint64), counts)
    short, long = _beginnings(data, offsets)
    buckets = [(hashes, text), (short[long], text[long])]
    bytes_of = np.repeat(np.arange(n), np.diff(offsets))
    total = np.maximum(np.bincount(bytes_of, minlength=n), 1)
    key = (text << np.uint64(44)) | (hashes >> np.uint64(20))
    distinct = np.bincount((vt.counted(key)[0] >> np.uint64(44)).astype(np.int64), minlength=n)
    words = np.maximum(counts, 1)
    step = lambda x, k: np.minimum(np.floor(x * k), k).astype(np.uint64)
    shape = [
        step(np.where(counts < 30, 1.0, distinct / words), 10) + np.uint64(16) * np.minimum(np.log2(words), 15).astype(np.uint64),
        step(np.bincount(bytes_of, _SYMBOL[data], n) / total, 20),
        step(np.bincount(bytes_of, _UPPER[data], n) / total, 10),
        step(np.minimum(total / words / 40, 1), 20),
    ]
    for k, x in enumerate(shape):
        buckets.append((vt.mix64(x + _KINDS[k]), np.arange(n, dtype=np.uint64)))
    hashes, text = (np.concatenate(x) for x in zip(*buckets, strict=True))
    found, _ = vt.counted((text << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS)))
    where = np.searchsorted(found, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))
    return (found & np.uint64((1 << BITS) - 1)).astype(np.int64), where


def _beginnings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, a hash of its first bytes, and whether it has more of them."""
    head, sizes = vt.word_heads(data, offsets, PREFIX)
    return vt.mix64(head + _KINDS[6]), sizes > PREFIX


@dataclass
class Ordinal:
    """P(grade > k) = 1 / (1 + exp(threshold k - weights . features))."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: np.ndarray, where: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text for each threshold."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[found], dtype=np.float64)])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - (sums[where[1:]] - sums[where[:-1]])[:, None], -500, 500)))


def fit(found: np.ndarray, where: np.ndarray, target: np.ndarray, grades: list[int], population: np.ndarray, settings: Settings) -> Ordinal:
    """Adaptive gradient steps on the likelihood of the cumulative logits; weak weights shrink to zero.

    Documents weigh as much as their grade's share of all rated documents asks (``population``), so a text without evidence gets the
    grades' own frequencies.
    """
    rng, m = np.random.default_rng(settings.seed), len(grades)
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    low, gaps = np.zeros(1), np.zeros(max(m - 2, 0))  # thresholds: low, then low plus sums of exp(gaps)
    share = population / np.maximum(np.bincount(target, minlength=m), 1)
    weight = share[target] / share[target].mean()
    odds = np.log(np.cumsum(population)[:-1] / (population.sum() - np.cumsum(population)[:-1]))
    low[:] = odds[:1]
    gaps[:] = np.log(np.maximum(np.diff(odds), 0.05))
    cuts = lambda: np.concatenate([low, low + np.cumsum(np.exp(gaps))])
    square = np.full(m - 1, 1e-6)
    for _ in range(settings.epochs):
        order = rng.permutation(len(target))
        for i in range(0, len(order), settings.batch):
            at = order[i : i + settings.batch]
            sizes = where[at + 1] - where[at]
            index = found[np.repeat(where[at] - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())]
            row = np.repeat(np.arange(len(at)), sizes)
            s, theta = np.bincount(row, w[index], len(at)), np.concatenate([[-np.inf], cuts(), [np.inf]])
            below, upto = 1 / (1 + np.exp(np.clip(s - theta[target[at]], -500, 500))), 1 / (1 + np.exp(np.clip(s - theta[target[at] + 1], -500, 500)))
            p = np.maximum(upto - below, 1e-9)
            d_low, d_up = below * (1 - below) / p, upto * (1 - upto) / p
            # Derivatives of -log p by the score and by both thresholds around the grade.
            g = np.clip(d_up - d_low, -5, 5) * weight[at]
            gw = np.bincount(index, g[row], 1 << BITS)
            hit = np.unique(index)
            seen[hit] += gw[hit] ** 2
            pace = settings.rate / np.sqrt(seen[hit])
            stepped = w[hit] - pace * gw[hit]
            w[hit] = np.sign(stepped) * np.maximum(np.abs(stepped) - pace * settings.sparsity * len(at), 0)
            gt = np.bincount(target[at], d_low * weight[at], m)[1:] - np.bincount(target[at], d_up * weight[at], m)[:-1]
            square += gt**2
            gt = settings.rate * gt / np.sqrt(square)
            steps = np.exp(gaps)
            low -= gt.sum()
            gaps -= np.array([gt[k + 1 :].sum() * steps[k] for k in range(m - 2)])
    return Ordinal(grades, w, cuts())


def _sample(docs: DataFrame, ratings: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and grades of a bounded number of documents of each grade, drawn by the hash of their ids."""
    ids = drawn(ratings, "grade", settings.docs_each)
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(2))
            for i, j in vt.slices(offsets):
                found, where = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["doc_id", "grade", "found"])

    table = texts.mapInArrow(run, "doc_id bigint, grade int, found array<int>").toArrow().sort_by([("grade", "ascending"), ("doc_id", "ascending")])
    lists = table["found"].combine_chunks()
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy().astype(np.int64), (offsets - offsets[0]).astype(np.int64), table["grade"].to_numpy()


def rate(docs: DataFrame, ratings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Expected grade of every text: the columns of ``docs``, then ``expected_grade``, ``p_top`` and ``p_bottom``.

    ``ratings`` (``doc_id``, ``grade`` as an int) of any of the documents teach, with a bounded number of each grade, drawn before any text
    is read; of several grades of a document the lowest counts. ``p_top`` is the tail probability of the highest grade, ``p_bottom`` that of the lowest; ``expected_grade`` weighs the grades by theirs.

    A null text is an empty one, judged by the thresholds alone. With fewer than two grades to learn from, the only grade (or 0)
    is expected, with p_top 1 and p_bottom 0. Repeated rows are judged alike; an empty table gives an empty result; columns
    that have the names of the new ones are replaced.
    """
    known = ratings.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    found, where, grade = _sample(docs, known, settings)
    grades = sorted({int(g) for g in grade})
    sizes = {int(r["grade"]): r["count"] for r in known.filter(F.col("grade").isin(grades)).groupBy("grade").count().collect()} if len(grades) > 1 else {}
    model = fit(found, where, np.searchsorted(grades, grade), grades, np.array([float(sizes[g]) for g in grades]), settings) if len(grades) > 1 else None
    sent = docs.sparkSession.sparkContext.broadcast((model, grades))
    new = ("expected_grade", "p_top", "p_bottom")
    kept = docs.select(*[c for c in docs.columns if c not in new])
    names, at = kept.columns, kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grades = sent.value
        for batch in batches:
            n = batch.num_rows
            expected, top, bottom = np.full(n, float(grades[0]) if grades else 0.0), np.ones(n), np.zeros(n)
            if model:
                data, offsets = vt.text_bytes(batch.column(at))
                for i, j in vt.slices(offsets):
                    tails = model.tails(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                    expected[i:j] = grades[0] + tails @ np.diff(np.array(grades, float))
                    top[i:j], bottom[i:j] = tails[:, -1], 1 - tails[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (expected, top, bottom))], [*names, *new])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new]]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for toxic, 1 for poor, 2 for good; null if there is no rating."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2).cast("int")
