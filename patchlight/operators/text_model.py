"""A weighted text classifier: hashed words and pairs of words, document frequencies, logistic regression.

Terms are hashed into a fixed number of places, so the document frequencies are a sketch of fixed size and no vocabulary is gathered. The
terms of all labelled rows are counted and written once, packed by the batch, and once more as the numbers that they weigh; each step of the
fit reads those and brings back one vector per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.staged import staged


#: Each step's tasks have about so many rows each, unless that makes too many tasks.
TASK_ROWS = 2000
#: So many rows are packed together: what a step holds of them at once stays small.
PACK = 256
#: Packs go to Python in batches of so many bytes (and a pack), not of 10,000 packs.
BATCH_BYTES = 1 << 21


@dataclass(frozen=True)
class Settings:
    """``places`` of terms; at most so many ``tasks`` read the rows' features.

    A place that fewer than ``least_df`` of them have says nothing. ``strength`` weighs the rows' loss against half the squared length of the
    coefficients; ``steps`` bounds the fit.
    """

    places: int = 1 << 16
    tasks: int = 32
    least_df: int = 3
    strength: float = 1000.0
    steps: int = 60


def terms(text: Column, places: int) -> Column:
    """The places of a text's words, of two characters or more and lower-cased, and of its pairs of neighbouring words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))

    def with_pairs(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(found, F.filter(pairs, lambda p: p.isNotNull()))

    # The words are an element of an array, so that the pattern runs once and not at each of their uses.
    every = F.get(F.transform(F.array(words), with_pairs), F.lit(0))
    return F.transform(every, lambda w: F.pmod(F.xxhash64(w), F.lit(places)).cast("int"))


def _counted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of lists of places: the row, the place and how often it occurs there, by row and place."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    place = lists.flatten().to_numpy()
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[at], place[at], np.diff(np.append(at, len(row)))


def _weighed(lists: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_counted``, with (1 + log count) * idf in place of counts, each row of length 1."""
    row, place, n = _counted(lists)
    x = (1 + np.log(n)) * idf[place]
    length = np.sqrt(np.bincount(row, x * x, len(lists)))
    return row, place, x / np.where(length > 0, length, 1)[row]


@dataclass(frozen=True)
class TextModel:
    """P(label 1 | text) = sigmoid(intercept + coefficients . features)."""

    idf: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def probability(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        """Adds the column ``name``. A null or empty text has the intercept's probability."""
        held = rows.withColumn("__terms", terms(F.col(text), len(self.idf)))
        schema = rows.withColumn(name, F.lit(0.0)).schema
        arrow, sent = to_arrow_schema(schema), rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                row, place, x = _weighed(batch.column(batch.num_columns - 1), model.idf)
                score = model.intercept + np.bincount(row, x * model.coefficients[place], batch.num_rows)
                cols = [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-score)))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        return held.mapInArrow(run, schema)


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """The least point of a smooth convex ``f`` (value and slope), by limited-memory quasi-Newton steps that are halved until they help."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() <= tolerance * max(1.0, abs(value)):
            break
        q, kept = slope.copy(), []
        for s, y in reversed(moves):
            a = (s @ q) / (y @ s)
            q -= a * y
            kept.append(a)
        if moves:
            s, y = moves[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(slope).max())
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        pace = 1.0
        while True:
            to = x - pace * q
            new_value, new_slope = f(to)
            if new_value <= value - 1e-4 * pace * (slope @ q) or pace < 1e-8:
                break
            pace /= 2
        if (new_slope - slope) @ (to - x) > 1e-12:
            moves = [*moves[1 - memory :], (to - x, new_slope - slope)]
        x, value, slope = to, new_value, new_slope
    return x


def sampled(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each label, in the order of a hash of ``key``; partial sums by its first bits say how far that order is needed.

    For those who want no more of them: ``fit`` learns from all rows that it is given.

    That is a row for each label at most, so it is broadcast. Only the rows that share the first bits of a label's last one are ranked, the others stay where they are: no task gets a label's texts.
    """
    drawn = rows.withColumn("__draw", F.xxhash64(key)).withColumn("__head", F.shiftrightunsigned("__draw", 48))
    upto = F.sum("n").over(Window.partitionBy(label).orderBy("__head"))
    counts = drawn.groupBy(label, "__head").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    ends = counts.filter((F.col("upto") >= most) & (F.col("upto") - F.col("n") < most))
    last = ends.select(F.col(label).alias("__label"), F.col("__head").alias("__last"), (most - F.col("upto") + F.col("n")).alias("__rest"))
    met = drawn.join(F.broadcast(last), F.col(label).eqNullSafe(F.col("__label")), "left")
    clear = met.filter(F.col("__last").isNull() | (F.col("__head") < F.col("__last")))
    place = F.row_number().over(Window.partitionBy(label).orderBy("__draw"))
    tied = met.filter(F.col("__head") == F.col("__last")).withColumn("__place", place).filter((F.col("__place") <= most) & (F.col("__place") <= F.col("__rest")))
    return clear.select(*rows.columns).unionByName(tied.select(*rows.columns))


#: Rows and their terms, packed: ``y`` and ``w`` of the rows; by row and place, how many places each row has (``lengths``), the places, and the counts.
PACKED = ["y", "w", "lengths", "places", "counts"]
_TYPES = dict(zip(PACKED, (np.float64, np.float64, np.int32, np.int32, np.int32), strict=True))
#: The same with the terms' weights in place of counts, each row of length 1, without the places that say nothing.
WEIGHED = [*PACKED[:-1], "weights"]


def _types_weighed(places: int) -> dict[str, type]:
    """Of ``WEIGHED``; places in two bytes where they fit, as every step reads them."""
    return {c: _TYPES.get(c, np.float32) for c in WEIGHED} | ({"places": np.uint16} if places <= 1 << 16 else {})


def _pack(held: Iterator[np.ndarray], types: dict[str, type]) -> pa.RecordBatch:
    cols = [pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in zip(held, types.values(), strict=True)]
    return pa.RecordBatch.from_arrays(cols, list(types))


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` (``terms``, ``y``, ``w``) with their terms counted, a row of bytes for ``PACK`` of them, as every step reads all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PACK):
                # A slice's offsets don't begin at 0, those of a copy do.
                batch = whole.take(pa.array(np.arange(at, min(at + PACK, whole.num_rows))))
                row, place, n = _counted(batch.column(0))
                yield _pack((batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.bincount(row, minlength=batch.num_rows), place, n), _TYPES)

    return rows.select("terms", "y", "w").mapInArrow(run, ", ".join(f"{c} binary" for c in PACKED))


def weighed(counted: DataFrame, idf: np.ndarray) -> DataFrame:
    """``packed`` rows as ``WEIGHED``."""
    sent, types = counted.sparkSession.sparkContext.broadcast(idf), _types_weighed(len(idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = sent.value
        for y, w, lengths, place, n in _unpacked(batches, _TYPES):
            row, x = np.repeat(np.arange(len(y)), lengths), (1 + np.log(n)) * idf[place]
            size = np.sqrt(np.bincount(row, x * x, len(y)))
            row, place, x = row[said := x > 0], place[said], (x / np.where(size > 0, size, 1)[row])[said]
            yield _pack((y, w, np.bincount(row, minlength=len(y)), place, x), types)

    return counted.mapInArrow(run, ", ".join(f"{c} binary" for c in WEIGHED))


def _unpacked(batches: Iterator[pa.RecordBatch], types: dict[str, type]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(row, types.values(), strict=True))


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of the vectors of numbers that the tasks bring back."""
    return sum((np.frombuffer(x.as_buffer()) for x in parts.toArrow()["part"]), np.zeros(1))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ``BATCH_BYTES``, unless the session sets a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    if own is None:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)


def fit(rows: DataFrame, text: str, label: str, weight: str, settings: Settings = Settings()) -> TextModel:
    """Learns from all ``rows``: their ``label`` (0.0 or 1.0) and non-negative ``weight``, null as 0. Without rows all is as likely as not."""
    with _small_batches(rows.sparkSession):
        return _fitted(rows, text, label, weight, settings)


def _fitted(rows: DataFrame, text: str, label: str, weight: str, settings: Settings) -> TextModel:
    own = rows.select(terms(F.col(text), settings.places).alias("terms"), F.col(label).cast("double").alias("y"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"))
    counted = staged(packed(own), "text-counts")
    spark, places, types = rows.sparkSession, settings.places, _types_weighed(settings.places)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(places + 1)
        for y, _, _, place, _ in _unpacked(batches, _TYPES):
            out[:-1] += np.bincount(place, minlength=places)
            out[-1] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["part"])

    sums = _summed(counted.coalesce(settings.tasks).mapInArrow(frequencies, "part binary"))
    n, df = int(sums[-1]), sums[:-1] if len(sums) > 1 else np.zeros(places)
    idf = np.where(df >= settings.least_df, np.log((1 + n) / (1 + df)) + 1, 0.0)
    features = staged(weighed(counted, idf), "text-features").coalesce(max(1, min(settings.tasks, -(-n // TASK_ROWS))))

    def value_and_slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sent.value
            out = np.zeros(places + 2)
            for y, w, lengths, place, v in _unpacked(batches, types):
                place, score, some = place.astype(np.intp), np.full(len(y), x[-1]), lengths > 0
                if len(v):
                    score[some] += np.add.reduceat(v * x[place], (np.cumsum(lengths) - lengths)[some])
                gap = w * (1 / (1 + np.exp(-score)) - y)
                out[:places] += np.bincount(place, v * np.repeat(gap, lengths), places)
                out[places] += gap.sum()
                out[-1] += float(w @ np.logaddexp(0, np.where(y == 1, -score, score)))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["part"])

        out = _summed(features.mapInArrow(run, "part binary"))
        sent.destroy()
        loss, slope = (out[-1], out[:-1]) if len(out) > 1 else (0.0, np.zeros(places + 1))
        pull = np.append(x[:-1], 0.0)
        return settings.strength * float(loss) + float(pull @ pull) / 2, settings.strength * slope + pull

    x = minimised(value_and_slope, np.zeros(places + 1), settings.steps)
    return TextModel(idf, x[:-1], float(x[-1]))
