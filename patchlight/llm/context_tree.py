"""Context-tree weighting over bytes: a model of the corpus whose mixture gives the code length of every byte.

A byte is eight binary decisions, so each context holds a tree of 255 decision nodes. Here are the shallow contexts, the last
three bytes: the nearest exactly (256), the two before by 32 classes, so there are at most 2**18 of them whatever
the corpus holds; ``deep_tree`` continues each with the exact bytes. Every node of every depth has the counts of all
training bytes in its context, a Krichevsky-Trofimov estimate from them, and the weighting that mixes its
own estimate with its children's by halves; a trained model predicts with the posterior weights that this gives.
"""

from __future__ import annotations

import numpy as np

#: Ends a text, and fills the context before its first byte; UTF-8 never holds it.
END = 0xFF
CLASS_BITS = 5
DEPTH = 3
_DEEP = 1 << (8 + 2 * CLASS_BITS)


def _classes() -> np.ndarray:
    """32 classes of bytes: each letter without its case, and six kinds of other byte."""
    out = np.full(256, 28, np.uint32)  # other ASCII
    for k in range(26):
        out[[65 + k, 97 + k]] = k
    out[[0x20, *range(0x09, 0x0E)]] = 26
    out[48:58] = 27
    out[0x80:0xC0] = 29
    out[0xC0:0xFF] = 30
    out[END] = 31
    return out


CLASS = _classes()


def with_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out with three END bytes before the first and after each; where each text begins in that."""
    n = len(offsets) - 1
    out = np.full(len(data) + DEPTH * (n + 1), END, np.uint8)
    at = np.arange(len(data)) + DEPTH * (1 + np.repeat(np.arange(n), np.diff(offsets)))
    out[at] = data
    return out, offsets[:-1] + DEPTH * np.arange(1, n + 1)


def cells(laid: np.ndarray) -> np.ndarray:
    """For each byte from the fourth on, its deepest context and itself as one number of 26 bits."""
    near, far = laid.astype(np.uint32), CLASS[laid]
    return (((near[2:-1] << CLASS_BITS | far[1:-2]) << CLASS_BITS | far[:-3]) << 8) | near[3:]


def text_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the bytes of each text and of the END after it, and where each text's begin."""
    laid, begin = with_ends(data, offsets)
    every = cells(laid)
    sizes = np.diff(offsets) + 1
    where = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(where[-1]) + np.repeat(begin - DEPTH - where[:-1], sizes)
    return every[index], where


def _levels(counts: np.ndarray) -> list[np.ndarray]:
    """Counts of bytes, the last axis 256 long, as counts of both bits at each decision: arrays of shape (..., 2**d, 2)."""
    out, now = [], counts
    for _ in range(8):
        pairs = now.reshape(*now.shape[:-1], -1, 2)
        out.insert(0, pairs)
        now = pairs.sum(-1)
    return out


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 decision nodes, from counts of bytes."""
    flat = [x.reshape(*counts.shape[:-1], -1, 2) for x in _levels(counts)]
    both = np.concatenate(flat, axis=-2)
    return both[..., 0], both[..., 1]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x of at least 1/2, by Stirling's series above 7."""
    y, shift = np.array(x, np.float64), np.zeros_like(x, dtype=np.float64)
    for _ in range(7):
        low = y < 7
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)


def _mixed(counts: np.ndarray, log_below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one depth's contexts: own probability of a one, share of the own estimate, and log of the weighted probability.

    log_below: the sum over children of their log weighted probabilities; None at the deepest.
    """
    zeros, ones = _nodes(counts.astype(np.float64))
    own, kt = (ones + 0.5) / (zeros + ones + 1.0), log_kt(zeros, ones)
    if log_below is None:
        return own, np.ones_like(own), kt
    weighted = np.logaddexp(kt, log_below) - np.log(2.0)
    return own, np.exp(kt - np.log(2.0) - weighted), weighted


def subtree(cell: np.ndarray, count: np.ndarray, log_deeper: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The contexts under one nearest byte: rows of ids and, for each, the probability of a one at its 255 nodes.

    Depth 1 is a single row, so a subtree has at most 1 + 32 + 1024 rows. Each row already mixes depths 1 up to its own; the root
    is mixed in by ``Model``. log_weighted is that of the depth-1 context. log_deeper: for each depth-3 context in order of
    ids, the sum over deeper children of their log weighted probabilities. left3 is the share that depth 3 leaves to them, own3 what
    that share says where no child was seen.
    """
    deep = (cell >> 8).astype(np.int64)
    ids3, row3 = np.unique(deep, return_inverse=True)
    table3 = np.zeros((len(ids3), 256))
    np.add.at(table3, (row3, (cell & 255).astype(np.int64)), count)
    ids2, row2 = np.unique(ids3 >> CLASS_BITS, return_inverse=True)
    table2 = np.zeros((len(ids2), 256))
    np.add.at(table2, row2, table3)
    table1 = table2.sum(0, keepdims=True)
    own3, keep3, log3 = _mixed(table3, log_deeper)
    sum3 = np.zeros((len(ids2), 255))
    np.add.at(sum3, row2, log3)
    own2, keep2, log2 = _mixed(table2, sum3)
    own1, keep1, log1 = _mixed(table1, log2.sum(0, keepdims=True))
    # On the way down the share that a depth leaves to deeper ones goes to the child on the path, and stays where none was seen.
    p1 = own1
    left1 = 1 - keep1
    seen2 = keep1 * own1 + left1 * own2
    left2 = left1 * (1 - keep2)
    seen3 = keep1 * own1 + (left1 * keep2) * own2
    seen3 = seen3[row2] + left2[row2] * own3
    depth = np.concatenate([[1], np.full(len(ids2), 2), np.full(len(ids3), 3)])
    ids = np.concatenate([[ids3[0] >> 2 * CLASS_BITS], ids2, ids3])
    ones = np.concatenate([p1, seen2, seen3]).astype(np.float32)
    return {"depth": depth, "id": ids, "ones": ones, "counts": table1[0], "log_weighted": log1[0], "left3": left2[row2] * (1 - keep3), "own3": own3}


class Model:
    """A trained tree: log10 probabilities of all 256 bytes in each context that training has seen."""

    def __init__(self, log10: np.ndarray, row: np.ndarray):
        self.log10, self.row = log10, row

    @classmethod
    def of(cls, depth: np.ndarray, ids: np.ndarray, ones: np.ndarray, counts: np.ndarray, log_weighted: np.ndarray) -> Model:
        """From the rows of all subtrees; counts and log_weighted have a row for each depth-1 context."""
        own, keep = cls.root(counts, log_weighted)
        mixed = np.concatenate([own, keep * own + (1 - keep) * ones]) if len(ones) else own
        row = np.zeros(_DEEP, np.int32)
        for d in (1, 2, 3):
            at, bits = np.flatnonzero(depth == d), CLASS_BITS * (3 - d)
            for k, i in zip(at, ids[at], strict=True):
                row[int(i) << bits : (int(i) + 1) << bits] = k + 1
        return cls(cls._bytes(mixed), row)

    @staticmethod
    def root(counts: np.ndarray, log_weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the empty context: probability of a one, and share of the own estimate."""
        total = counts.sum(0, keepdims=True) if len(counts) else np.zeros((1, 256))
        log_below = log_weighted.sum(0, keepdims=True) if len(counts) else np.zeros((1, 255))
        return _mixed(total, log_below)[:2]

    @staticmethod
    def _bytes(ones: np.ndarray) -> np.ndarray:
        """Log10 probabilities of the bytes from the probabilities of a one at the decision nodes."""
        out = np.empty((len(ones), 256), np.float32)
        for begin in range(0, len(ones), 4096):
            part = ones[begin : begin + 4096].astype(np.float64)
            now, first = np.zeros((len(part), 1)), 0
            for d in range(8):
                p = part[:, first : first + (1 << d)]
                now = np.stack([now + np.log10(1 - p), now + np.log10(p)], -1).reshape(len(part), -1)
                first += 1 << d
            out[begin : begin + 4096] = now
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log10 probability of each text with its END."""
        cell, where = text_cells(data, offsets)
        value = self.log10[self.row[cell >> 8], cell & 255]
        return np.add.reduceat(value.astype(np.float64), where[:-1]) if len(where) > 1 else np.zeros(0)
