"""Words and shingles of Arrow text columns, as numpy arrays.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. All functions
work on the UTF-8 bytes of a batch at once; there is no per-row Python in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 1 << 16
_PLACE = mix64((np.arange(_PLACES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TERM = mix64((np.arange(1, 65, dtype=np.uint64)) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of each text; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, where, held = col.buffers()
    offsets = np.frombuffer(where, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _layout(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, where each word begins among them, each byte's place in its word, and each text's first word."""
    full = ~space[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = full[begins]
    starts = np.flatnonzero(first)
    of = np.searchsorted(starts, offsets)
    held = data[full]
    at = np.flatnonzero(first[full])
    place = np.arange(len(held)) - np.repeat(at, np.diff(np.append(at, len(held))))
    return held, at, place, of


def _terms(held: np.ndarray, place: np.ndarray) -> np.ndarray:
    if not len(place) or int(place.max()) < _PLACES:
        return _PLACE[place] * _LOWER[held]
    return _PLACE[place % _PLACES] * (np.uint64(2) * (place // _PLACES).astype(np.uint64) + np.uint64(1)) * _LOWER[held]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in order, and for each text the index of its first word.

    The second array has one more entry than there are texts. ``space`` says of each byte whether it parts words.
    """
    held, at, place, of = _layout(data, offsets, space)
    return (mix64(np.add.reduceat(_terms(held, place), at)) if len(at) else np.zeros(0, np.uint64)), of


def word_heads(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the first ``size`` bytes of each word, and how many bytes each word has."""
    held, at, place, _ = _layout(data, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    terms = np.where(place < size, _terms(held, place), np.uint64(0))
    return mix64(np.add.reduceat(terms, at)), np.diff(np.append(at, len(held)))


def shingles(hashes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text in order, and where each text's begin.

    A text of fewer words, but at least one, has its whole sequence as its only shingle.
    """
    n = np.diff(of)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    where = np.concatenate([[0], np.cumsum(counts)])
    if not len(hashes):
        return np.zeros(0, np.uint64), where
    total = len(hashes)
    rolled = np.zeros(total, np.uint64)
    for k in range(min(size, total)):
        rolled[: total - k] += hashes[k:] * _TERM[k]
    long = n >= size
    index = np.arange(int(counts.sum())) - np.repeat(where[:-1], counts) + np.repeat(of[:-1], counts)
    out = rolled[index] if len(index) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(~long & (n > 0)):
        part = hashes[of[i] : of[i + 1]]
        out[where[i]] = np.append(part * _TERM[: len(part)], _TERM[40 + len(part)]).sum(dtype=np.uint64)
    return mix64(out), where


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as the signed ones that Spark's long holds."""
    return x.view(np.int64)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts (or how often each occurs)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


class Tally:
    """Counts of keys that are merged now and then, and handed on when they take much memory."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = counted(keys, counts)
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > self.most:
            merged = self._merged()
            if len(merged[0]) > self.most // 2:
                yield merged
            else:
                self.parts, self.held = [merged], len(merged[0])

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            yield self._merged()

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        out = counted(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
        self.parts, self.held = [], 0
        return out
