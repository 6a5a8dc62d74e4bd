"""Fixed-size filters over sets of 64-bit keys: a key that is in the set always passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as vt

#: 2**24 places in each of two tables, two megabytes each, whatever the set holds.
FILTER_BITS = 24
#: Places in one block of a table, as Spark's bitmap aggregate has them.
_BLOCK_BITS = 15
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def places(keys: np.ndarray, which: int) -> np.ndarray:
    return (vt.mix64(keys.view(np.uint64) + _SALTS[which]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Filter:
    """Whether keys may be in a set: two tables of bits, which stay packed, as each task's process holds those of all filters that are in use."""

    def __init__(self, tables: list[np.ndarray]):
        self.packed = tables

    def _set(self, which: int, keys: np.ndarray) -> np.ndarray:
        at = places(keys, which)
        return (self.packed[which][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Boolean for each key; the second table is asked only about those that pass the first."""
        out = self._set(0, keys)
        at = np.flatnonzero(out)
        out[at] = self._set(1, keys[at])
        return out


def build_filter(keys: DataFrame, col: str) -> Filter:
    """The filter of a column of longs. Spark sets the bits in blocks of 4 KB, at most 1024 of which reach the driver: 4 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy()
            at = np.concatenate([places(values, k) + (k << FILTER_BITS) for k in range(len(_SALTS))])
            yield pa.RecordBatch.from_arrays([pa.array(at >> _BLOCK_BITS), pa.array(at & ((1 << _BLOCK_BITS) - 1))], ["block", "at"])

    blocks = keys.select(col).mapInArrow(run, "block bigint, at bigint").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
    held = np.zeros((len(_SALTS) << FILTER_BITS - _BLOCK_BITS, (1 << _BLOCK_BITS) // 8), np.uint8)
    for block, bits in zip(blocks["block"].to_pylist(), blocks["bits"], strict=True):
        held[block] = np.frombuffer(bits.as_buffer(), np.uint8)
    return Filter([x.ravel() for x in np.split(held, len(_SALTS))])


def parted(rows: DataFrame, ids: DataFrame, col: str, id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose id (a long; null never) is surely not among ``ids``, and those of which it may be: a filter of fixed size tells."""
    sent = rows.sparkSession.sparkContext.broadcast(build_filter(ids, id_col or col))
    at = rows.columns.index(col)

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(at)
                passes = sent.value.passes(own.fill_null(0).to_numpy()) & own.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(passes == wanted))

        return rows.mapInArrow(run, rows.schema)

    return part(False), part(True)


def without(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """``rows`` whose id (a long; null never) is not among ``ids``: an anti-join that moves only rows that may be among them.

    What the filter lets pass is joined exactly, so a full filter costs time, not results.
    """
    clear, suspect = parted(rows, ids, col)
    return clear.unionByName(suspect.join(ids, col, "left_anti").select(*rows.columns))
