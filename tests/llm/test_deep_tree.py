import math
import random

import numpy as np
from pyspark.sql import functions as F

from patchlight.llm import context_tree as ct
from patchlight.llm import deep_tree as dt
from patchlight.llm import lm_scoring

from .conftest import DOCS
from .test_lm_scoring import Plain


class PlainDeep(Plain):
    """The same tree, node by node, with exact contexts of four bytes and more below the classes."""

    @staticmethod
    def walk(text):
        data = bytes([255] * dt.DEPTH) + (text or "").encode() + b"\xff"
        for i in range(dt.DEPTH, len(data)):
            one, two, three = data[i - 1], int(ct.CLASS[data[i - 2]]), int(ct.CLASS[data[i - 3]])
            back = [bytes(data[i - d : i][::-1]) for d in range(4, dt.DEPTH + 1)]
            path = [(), (one,), (one, two), (one, two, three)]
            for b in back:
                path.append((*path[-1], b))
            yield path, data[i]

    def weighted(self, context, prefix, depth):
        own = self.kt(*self.node(context, prefix, depth))
        if len(context) == dt.DEPTH:
            return own
        below = sum(self.weighted(c, prefix, depth) for c in self.counts if len(c) == len(context) + 1 and c[: len(context)] == context)
        return np.logaddexp(own, below) - math.log(2)


def test_scores_match_a_plain_deep_tree(spark, monkeypatch):
    taught = ["abcabcabc", "Abdabcab", "", "aéb", "xyzabcabd", "abcabcabc"]
    asked = ["abcabcabd", "ABCABC", "", "zz", "xyzabx", "bcabcab9abcabcé"]
    rows = [(k, t, "en", "a", 1, "taught") for k, t in enumerate(taught)] + [(k, t, "en", "a", 1, "asked") for k, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    plain = PlainDeep(taught)
    for size, merged, asking in ((8, 2, 3), (8, 256, 2048), (dt.CHUNK_BYTES, 256, 2048)):
        for name, value in (("CHUNK_BYTES", size), ("MERGED", merged), ("ASKING", asking)):
            monkeypatch.setattr(dt, name, value)
        got = lm_scoring.score(docs.withColumn("doc_id", F.concat("key", "doc_id")), F.col("key") == "asked").collect()
        assert len(got) == len(rows)
        for r in got:
            text = (taught if r["doc_id"].startswith("taught") else asked)[int(r["doc_id"].removeprefix("taught").removeprefix("asked"))]
            assert math.isclose(r["score"], plain.score(text), rel_tol=1e-4), (text, r["score"])


def test_what_is_gathered_grows_with_the_corpus(spark):
    """Texts that differ only in what three bytes by class can't tell apart; what a longer context says is certain."""
    rng = random.Random(5)
    pairs = [("".join(rng.choice("0123456789") for _ in range(6)), rng.choice("abcdefgh")) for _ in range(60)]
    docs = [(k, (a + b) * 8, "en", "a", 1, None) for k, (a, b) in enumerate(pairs)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm_scoring.score(spark.createDataFrame(docs, DOCS), F.lit(False)).collect()}
    assert max(got.values()) < 2
