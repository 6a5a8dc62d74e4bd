"""The exact contexts of the tree, below the classes of ``context_tree``: the last four and five bytes, as many as the corpus has.

A cell is a context of five bytes, nearest first, and the byte that follows, as one number of 48 bits, so that cells in
order hold the contexts of every depth side by side. Chunks of text give their distinct cells in blocks by bucket of
the shallow context; a bucket's nodes are made from all chunks' cells, and it answers each chunk's cells with log10 probabilities.
Only nodes that training has met are held: elsewhere a seen context says one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_tree as ct
from . import vectext as vt
from .storage import saved

DEPTH = 5
BUCKETS = 1024
#: Bytes of text in a chunk, at most, unless it is one longer text.
CHUNK_BYTES = 1 << 23
#: Blocks of one bucket that are merged at once, and chunks that one copy of a bucket's nodes answers, about.
MERGED = 256
ASKING = 2048
#: Cells of chunks that a bucket answers at once.
_ANSWERED = 1 << 21
_BYTE = np.uint64(255)
_8 = np.uint64(8)


def text_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the bytes of each text and of the END after it, and where each text's begin."""
    n, size = len(offsets) - 1, len(data) + DEPTH * len(offsets)
    laid = np.full(size, ct.END, np.uint8)
    sizes = np.diff(offsets)
    laid[np.arange(len(data)) + DEPTH * (1 + np.repeat(np.arange(n), sizes))] = data
    every = np.zeros(size - DEPTH, np.uint64)
    for back in range(1, DEPTH + 1):
        every |= laid[DEPTH - back : size - back].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
    every |= laid[DEPTH:]
    where = np.concatenate([[0], np.cumsum(sizes + 1)])
    return every[np.arange(where[-1]) + np.repeat(offsets[:-1] + DEPTH * np.arange(n) - where[:-1], sizes + 1)], where


def shallow(context: np.ndarray, depth: int) -> np.ndarray:
    """The depth-3 ids of exact contexts of ``depth`` bytes."""
    at = lambda k: ((context >> np.uint64(8 * (depth - k))) & _BYTE).astype(np.int64)
    return (at(1) << 2 * ct.CLASS_BITS) | (ct.CLASS[at(2)].astype(np.int64) << ct.CLASS_BITS) | ct.CLASS[at(3)].astype(np.int64)


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return (vt.mix64(ids.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int32)


def split(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted cells by bucket, and where each of the buckets begins in it."""
    bucket = bucket_of(shallow(cells >> _8, DEPTH))
    return np.argsort(bucket, kind="stable"), np.searchsorted(np.sort(bucket), np.arange(BUCKETS + 1))


def pack(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte place by byte place, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(held: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(held, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def pack_cells(cells: np.ndarray) -> bytes:
    return pack(np.diff(cells, prepend=np.uint64(0)))


def unpack_cells(held: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(held, n), dtype=np.uint64)


class Chunk:
    """Texts put together, and the counts of their cells, those of held-out texts as 0."""

    def __init__(self):
        self.marked, self.texts, self.sizes, self.bytes = [], [], [], 0

    def add(self, data: np.ndarray, offsets: np.ndarray, held_out: np.ndarray) -> None:
        cells, where = text_cells(data, offsets)
        marked = (cells << np.uint64(1)) | np.repeat(held_out, np.diff(where)).astype(np.uint64)
        self.marked.append(vt.counted(marked))
        if sum(len(k) for k, _ in self.marked[1:]) > max(1 << 20, len(self.marked[0][0])):
            self.marked = [self._merged()]
        self.texts.append(data)
        self.sizes.append(np.diff(offsets))
        self.bytes += len(data)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        marked, n = self._merged()
        taught = np.where(marked & np.uint64(1), 0, n)
        return vt.counted(marked >> np.uint64(1), taught)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return vt.counted(np.concatenate([k for k, _ in self.marked]), np.concatenate([n for _, n in self.marked]))

    def text(self) -> bytes:
        return pa.compress(np.concatenate(self.texts).tobytes(), codec="zstd", asbytes=True)


def blocks(cells: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """A chunk's cells by bucket: bucket, how many, cells and counts."""
    order, first = split(cells)
    cells, counts = cells[order], counts[order].astype(np.uint64)
    for b in np.flatnonzero(np.diff(first)):
        i, j = first[b], first[b + 1]
        yield int(b), int(j - i), pack_cells(cells[i:j]), pack(counts[i:j])


_SMALL = np.arange(1 << 16, dtype=np.float64)
_HALF, _WHOLE = ct._log_gamma(_SMALL + 0.5), ct._log_gamma(_SMALL + 1.0)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    total = zeros + ones
    low = np.minimum(total, len(_SMALL) - 1)
    out = _HALF[np.minimum(zeros, low)] + _HALF[np.minimum(ones, low)] - np.log(np.pi) - _WHOLE[low]
    big = np.flatnonzero(total > low)
    out[big] = ct.log_kt(zeros[big].astype(np.float64), ones[big].astype(np.float64))
    return out


class Nodes:
    """The decision nodes that training has met, of depths 4 to ``DEPTH``, from a bucket's counted cells."""

    def __init__(self, cells: np.ndarray, n: np.ndarray):
        self.contexts, self.keys, self.own, self.keep = {}, {}, {}, {}
        below: list = [None] * 8
        for depth in range(DEPTH, 3, -1):
            context, byte = cells >> _8, (cells & _BYTE).astype(np.int64)
            self.contexts[depth] = np.unique(context)
            for j in range(8):
                key = (context << _8) | ((1 << j) | (byte >> (8 - j))).astype(np.uint64)
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                ones = np.add.reduceat(np.where(byte >> (7 - j) & 1, n, 0), at) if len(at) else np.zeros(0, np.int64)
                zeros = (np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)) - ones
                key, log = key[at], _log_kt(zeros, ones)
                self.keys[depth, j], self.own[depth, j] = key, (ones + 0.5) / (zeros + ones + 1.0)
                if below[j] is None:
                    self.keep[depth, j] = np.ones(len(key))
                else:
                    child, logs = below[j]
                    deeper = np.bincount(np.searchsorted(key, self._up(child)), logs, len(key))
                    weighted = np.logaddexp(log, deeper) - np.log(2.0)
                    self.keep[depth, j] = np.exp(log - np.log(2.0) - weighted)
                    log = weighted
                below[j] = (key, log)
            if depth > 4:
                cells, n = vt.counted(self._up(cells), n)
        self.cells4, self.n4, self.logs = cells, n, below

    @staticmethod
    def _up(key: np.ndarray) -> np.ndarray:
        """The same node, or byte, one byte of context less deep."""
        return ((key >> np.uint64(16)) << _8) | (key & _BYTE)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depth-3 ids, their counts of bytes, and the sums over their children of log weighted probabilities."""
        ids, row = np.unique(shallow(self.cells4 >> _8, 4), return_inverse=True)
        counts, logs = np.zeros((len(ids), 256)), np.zeros((len(ids), 255))
        np.add.at(counts, (row, (self.cells4 & _BYTE).astype(np.int64)), self.n4)
        for key, log in self.logs:
            np.add.at(logs, (np.searchsorted(ids, shallow(key >> _8, 4)), (key & _BYTE).astype(np.int64) - 1), log)
        return ids, counts, logs

    def ones(self, cells: np.ndarray, j: int, own3: np.ndarray) -> np.ndarray:
        """What the contexts below depth 3 say for the j-th decision of each cell: own3 where none was seen."""
        byte = (cells & _BYTE).astype(np.int64)
        node = ((1 << j) | (byte >> (8 - j))).astype(np.uint64)
        out, share, stays, on = np.zeros(len(cells)), np.ones(len(cells)), own3, np.ones(len(cells), bool)
        for depth in range(4, DEPTH + 1):
            context = cells >> np.uint64(8 * (DEPTH + 1 - depth))
            on = on & _held(self.contexts[depth], context)[1]
            at, met = _held(self.keys[depth, j], (context << _8) | node)
            own = np.where(met, self.own[depth, j][at], 0.5) if len(self.keys[depth, j]) else np.full(len(cells), 0.5)
            keep = np.where(met, self.keep[depth, j][at], 0.5) if len(self.keys[depth, j]) else np.full(len(cells), 0.5)
            # The share that came here goes to the own estimate and on, or ends at the depth above.
            ends = ~on & (share > 0)
            out[ends] += (share * stays)[ends]
            share = np.where(on, share, 0.0)
            if depth == DEPTH:
                return out + share * own
            out += share * keep * own
            share, stays = share * (1 - keep), own
        return out


def _held(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    return at, (keys[at] == asked if len(keys) else np.zeros(len(asked), bool))


class Shallow:
    """Depth-3 rows of a bucket, and the model of all contexts above them."""

    def __init__(self, ids: np.ndarray, ones: np.ndarray, left: np.ndarray, own: np.ndarray, above: ct.Model, root: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(ids)
        self.ids, self.left, self.own, self.above = ids[order], left[order] * (1 - root[1]), own[order], above
        self.ones = root[1] * root[0] + (1 - root[1]) * ones[order]


def answers(cells: np.ndarray, nodes: Nodes, top: Shallow) -> np.ndarray:
    """Log10 probabilities of distinct sorted cells."""
    ids, byte = shallow(cells >> _8, DEPTH), (cells & _BYTE).astype(np.int64)
    row, seen = _held(top.ids, ids)
    out = top.above.log10[top.above.row[ids], byte].astype(np.float64)
    cells, byte, row = cells[seen], byte[seen], row[seen]
    if not len(cells):
        return out
    total = np.zeros(len(cells))
    for j in range(8):
        h = ((1 << j) | (byte >> (8 - j))) - 1
        own3 = top.own[row, h]
        p = top.ones[row, h] + top.left[row, h] * (nodes.ones(cells, j, own3) - own3)
        total += np.log10(np.where(byte >> (7 - j) & 1, p, 1 - p))
    out[seen] = total
    return out


def _merged(keys: list, counts: list, n: list) -> tuple[np.ndarray, np.ndarray]:
    """The counted training cells of blocks."""
    cells, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, c, size in zip(keys, counts, n, strict=True):
        k, c = unpack_cells(k, size), unpack(c, size).astype(np.int64)
        cells.append(k[c > 0])
        many.append(c[c > 0])
    return vt.counted(np.concatenate(cells), np.concatenate(many))


_GROWN = "bucket int, n bigint, cells binary, counts binary, id int, tables binary, logs binary"
_ROWS = "depth int, id int, ones binary, counts binary, log_weighted binary, left3 binary, own3 binary"


def merged_blocks(held: DataFrame, chunks: int) -> DataFrame:
    """The blocks of ``chunks`` chunks, merged in rounds until a bucket has few, so that no task holds more than some hundred."""

    def run(table: pa.Table) -> pa.Table:
        cells, n = _merged(*[table[c].to_pylist() for c in ("cells", "counts", "n")])
        first = {c: table[c].slice(0, 1) for c in ("bucket", "part")}
        return pa.table({**first, "n": pa.array([len(cells)]), "cells": pa.array([pack_cells(cells)]), "counts": pa.array([pack(n.astype(np.uint64))])})

    parts = -(-chunks // MERGED)
    now = held.select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(max(parts, 1))).alias("part"), "n", "cells", "counts")
    while parts > 1:
        now = now.groupBy("bucket", "part").applyInArrow(run, "bucket int, part bigint, n bigint, cells binary, counts binary")
        parts = -(-parts // MERGED)
        now = now.withColumn("part", F.pmod("part", F.lit(parts)))
    return now.drop("part")


def grow(held: DataFrame) -> DataFrame:
    """Blocks (``merged_blocks``) as one row of counted cells per bucket, and one row per depth-3 context."""

    def run(table: pa.Table) -> pa.Table:
        cells, n = _merged(*[table[c].to_pylist() for c in ("cells", "counts", "n")])
        ids, counts, logs = Nodes(cells, n).tables()
        more = len(ids)
        row = lambda first, rest, kind: pa.array([first, *rest], kind)
        return pa.table(
            {
                "bucket": row(table["bucket"][0].as_py(), bucket_of(ids).tolist(), pa.int32()),
                "n": row(len(cells), [None] * more, pa.int64()),
                "cells": row(pack_cells(cells), [None] * more, pa.binary()),
                "counts": row(pack(n.astype(np.uint64)), [None] * more, pa.binary()),
                "id": row(None, ids.tolist(), pa.int32()),
                "tables": row(None, [x.tobytes() for x in counts], pa.binary()),
                "logs": row(None, [x.tobytes() for x in logs], pa.binary()),
            }
        )

    return held.select("bucket", "n", "cells", "counts").groupBy("bucket").applyInArrow(run, _GROWN)


def shallow_rows(grown: DataFrame) -> DataFrame:
    """The shallow contexts, weighted with what is below them. A nearest byte has at most 1024 depth-3 contexts, and is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tables = np.stack([np.frombuffer(x, np.float64) for x in pdf["tables"]])
        at, byte = np.nonzero(tables)
        t = ct.subtree((pdf["id"].to_numpy()[at] << 8 | byte).astype(np.uint32), tables[at, byte], np.stack([np.frombuffer(x, np.float64) for x in pdf["logs"]]))
        n, deep = len(t["id"]), len(pdf)
        first, lead = [None] * (n - 1), [None] * (n - deep)
        of = lambda x: [r.tobytes() for r in x.astype(np.float32)]
        return pd.DataFrame(
            {
                "depth": t["depth"].astype(np.int32),
                "id": t["id"].astype(np.int32),
                "ones": of(t["ones"]),
                "counts": [t["counts"].tobytes(), *first],
                "log_weighted": [t["log_weighted"].tobytes(), *first],
                "left3": lead + of(t["left3"]),
                "own3": lead + of(t["own3"]),
            }
        )

    return grown.filter("id IS NOT NULL").select("id", "tables", "logs").groupBy(F.shiftright("id", 2 * ct.CLASS_BITS)).applyInPandas(run, _ROWS)


def answered(held: DataFrame, chunks: int) -> DataFrame:
    """For each block its cells' log10 probabilities, from the counts of the blocks of all ``chunks`` chunks: ``chunk``, ``bucket``, ``said``.

    A bucket's nodes are copied for every two thousand chunks or so, so that no task answers more than their blocks.
    """
    spark = held.sparkSession
    grown = saved(grow(merged_blocks(held, chunks)), "lm-grown")
    rows = saved(shallow_rows(grown), "lm-shallow")
    few = rows.filter("depth < 3").toArrow().sort_by([("depth", "ascending"), ("id", "ascending")])
    stack = lambda name, kind, width: np.frombuffer(b"".join(x.as_py() for x in few[name].drop_null()), kind).reshape(-1, width)
    counts, logs = stack("counts", np.float64, 256), stack("log_weighted", np.float64, 255)
    above = ct.Model.of(few["depth"].to_numpy(), few["id"].to_numpy(), stack("ones", np.float32, 255), counts, logs)
    sent = spark.sparkContext.broadcast((above.log10, above.row, ct.Model.root(counts, logs)))

    def run(table: pa.Table) -> pa.Table:
        log10, row, root = sent.value
        rest = table.filter(pc.is_null(table["chunk"]))
        made = rest.filter(pc.is_null(rest["id"]))
        top = rest.filter(pc.is_valid(rest["id"]))
        asked = table.filter(pc.is_valid(table["chunk"])).drop_columns(["counts"])
        nodes = Nodes(*_merged(*[made[c].to_pylist() for c in ("cells", "counts", "n")]))
        wide = lambda c: np.frombuffer(b"".join(top[c].to_pylist()), np.float32).reshape(-1, 255).astype(np.float64)
        shallow_of = Shallow(top["id"].to_numpy(), wide("ones"), wide("left3"), wide("own3"), ct.Model(log10, row), root)
        sizes, said = asked["n"].to_numpy(), []
        parts = (np.cumsum(sizes) - sizes) // _ANSWERED
        for p in np.unique(parts):
            at = np.flatnonzero(parts == p)
            cells = np.concatenate([unpack_cells(asked["cells"][int(i)].as_py(), int(sizes[i])) for i in at])
            distinct, back = np.unique(cells, return_inverse=True)
            value = answers(distinct, nodes, shallow_of).astype(np.float32)[back]
            said += [x.tobytes() for x in np.split(value, np.cumsum(sizes[at])[:-1])]
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "said": pa.array(said, pa.binary())})

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    columns = ["bucket", "part", "chunk", "n", "cells", "counts", "id", "ones", "left3", "own3"]
    parts = max(-(-chunks // ASKING), 1)
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part")
    made = grown.filter("id IS NULL").select("bucket", "n", "cells", "counts", *none("bigint", "chunk"), *none("int", "id"), *none("binary", "ones", "left3", "own3"))
    # Each depth-3 context was grown by its bucket, so that says where its row belongs.
    top = rows.filter("depth = 3").join(grown.filter("id IS NOT NULL").select("id", "bucket"), "id")
    top = top.select("bucket", "id", "ones", "left3", "own3", *none("bigint", "chunk", "n"), *none("binary", "cells", "counts"))
    part = F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part")
    asked = held.select("bucket", part, "chunk", "n", "cells", *none("int", "id"), *none("binary", "counts", "ones", "left3", "own3"))
    copied = [x.select("*", each).select(columns) for x in (made, top)]
    every = copied[0].unionByName(copied[1]).unionByName(asked.select(columns))
    return every.groupBy("bucket", "part").applyInArrow(run, "chunk bigint, bucket int, said binary")


def scores(chunks: DataFrame, said: DataFrame) -> DataFrame:
    """Log10 probability of each text with its END, from its chunk's answers: ``row``, ``score``."""

    def run(texts: pa.Table, said: pa.Table) -> pa.Table:
        sizes = np.frombuffer(texts["sizes"][0].as_py(), np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = pa.decompress(texts["text"][0].as_py(), decompressed_size=int(offsets[-1]), codec="zstd", asbytes=True) if offsets[-1] else b""
        data, parts = np.frombuffer(raw, np.uint8), []
        for i, j in vt.slices(offsets):
            cells, where = text_cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own, back = np.unique(cells, return_inverse=True)
            parts.append((own, back.astype(np.int32), where))
        distinct = vt.counted(np.concatenate([p[0] for p in parts]))[0]
        said = said.sort_by("bucket")
        value = np.empty(len(distinct), np.float32)
        value[split(distinct)[0]] = np.frombuffer(b"".join(said["said"].to_pylist()), np.float32)
        out = [np.add.reduceat(value[np.searchsorted(distinct, part)][back].astype(np.float64), where[:-1]) for part, back, where in parts]
        return pa.table({"row": texts["row"][0].as_py() + np.arange(len(sizes)), "score": np.concatenate(out)})

    return chunks.select("chunk", "row", "sizes", "text").groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(run, "row bigint, score double")
