import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from patchlight.llm import context_tree as ct
from patchlight.llm import lm_scoring
from patchlight.llm import vectext as vt


def model_of(texts):
    cell, _ = ct.text_cells(*vt.text_bytes(pa.array(texts, pa.string())))
    keys, n = vt.counted(cell)
    subs = [ct.subtree(keys[(keys >> 18) == b].astype(np.uint32), n[(keys >> 18) == b]) for b in np.unique(keys >> 18)]
    return ct.Model.of(*[np.concatenate([s[x] for s in subs]) for x in ("depth", "id", "ones")], np.stack([s["counts"] for s in subs]), np.stack([s["log_weighted"] for s in subs]))


class Plain:
    """The same tree, node by node: contexts as tuples, KT by the product of its steps."""

    def __init__(self, texts):
        self.counts = {}
        for t in texts:
            for path, byte in self.walk(t):
                for c in path:
                    self.counts.setdefault(c, Counter())[byte] += 1

    @staticmethod
    def walk(text):
        data = bytes([255] * 3) + (text or "").encode() + b"\xff"
        for i in range(3, len(data)):
            one, two, three = data[i - 1], int(ct.CLASS[data[i - 2]]), int(ct.CLASS[data[i - 3]])
            yield [(), (one,), (one, two), (one, two, three)], data[i]

    def node(self, context, prefix, depth):
        c = self.counts.get(context, {})
        both = [0, 0]
        for byte, n in c.items():
            if byte >> (8 - depth) == prefix:
                both[byte >> (7 - depth) & 1] += n
        return both

    @staticmethod
    def kt(zeros, ones):
        out, seen = 0.0, [0, 0]
        for bit, n in ((0, zeros), (1, ones)):
            for _ in range(n):
                out += math.log((seen[bit] + 0.5) / (seen[0] + seen[1] + 1))
                seen[bit] += 1
        return out

    def weighted(self, context, prefix, depth):
        own = self.kt(*self.node(context, prefix, depth))
        if len(context) == 3:
            return own
        below = sum(self.weighted(c, prefix, depth) for c in self.counts if len(c) == len(context) + 1 and c[: len(context)] == context)
        return np.logaddexp(own, below) - math.log(2)

    def score(self, text):
        total = 0.0
        for path, byte in self.walk(text):
            for depth in range(8):
                prefix, p, share = byte >> (8 - depth), 0.0, 1.0
                seen = [c for c in path if c in self.counts]
                for c in seen:
                    zeros, ones = self.node(c, prefix, depth)
                    own = (ones + 0.5) / (zeros + ones + 1)
                    keep = math.exp(self.kt(zeros, ones) - math.log(2) - self.weighted(c, prefix, depth)) if c is not seen[-1] else 1.0
                    p += share * keep * own
                    share *= 1 - keep
                total += math.log10(p if byte >> (7 - depth) & 1 else 1 - p)
        return total


def test_scores_match_a_plain_tree():
    texts, asked = ["abcab", "abd", "", "aéb"], ["abcab", "abx", "", "zz"]
    got = model_of(texts).scores(*vt.text_bytes(pa.array(asked)))
    plain = Plain(texts)
    assert np.allclose(got, [plain.score(t) for t in asked], rtol=1e-5)


def test_bytes_have_probabilities_that_sum_to_one():
    m = model_of(["the cat sat on the mat " * 9, "the dog"])
    assert np.allclose((10.0 ** m.log10.astype(float)).sum(1), 1, atol=1e-4)


def test_base_scores_match_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 16)
    docs = odd_docs.unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 100))
    got = sorted(lm_scoring.score(docs, lm_scoring.remainder("doc_id", 7) == 2).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    rows = sorted(((r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in docs.collect()), key=lambda r: (str(r[0]), len(r[1])))
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    assert any(held) and len(got) == len(rows)
    for r, (k, t), h in zip(got, rows, held, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k, h, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_empty_and_untaught(no_docs, odd_docs):
    assert lm_scoring.score(no_docs, F.lit(False)).count() == 0
    r = lm_scoring.score(odd_docs.filter("doc_id = 7"), F.lit(True)).first()
    assert r["n_known"] == 0 and math.isclose(r["score"], 8 * 8 * math.log10(0.5), rel_tol=1e-5)
