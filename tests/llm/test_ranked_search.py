import math
import random
import re
from collections import Counter

import pytest

from patchlight.llm import ranked_search
from patchlight.llm.ranked_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, queries, k):
    held = [(d, Counter(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(q, i, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, queries, k):
    docs = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, term string, segment string")
    return sorted((tuple(r) for r in search(docs, spark.createDataFrame(queries, "item_id long, text string"), k).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_matches_every_score(spark, monkeypatch, small):
    if small:  # many segments and rounds
        for name, value in (("SEGMENT_DOCS", 7), ("SEGMENT_POSTINGS", 40), ("ROUND_TERMS", 30)):
            monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(11)
    draw = lambda n: " ".join(f"t{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(None, docs[6][1]), (None, None), (2000, ""), (2001, " .,\t"), (2002, "T1 t2é\x7ft3 " * 3000), (7, "t1_t2-T3")]
    queries = [(i, draw(rng.randrange(1, 25))) for i in range(20)] + [(50, docs[5][1]), (51, None), (52, "!!"), (53, "nowhere"), (54, "T1 t1 T2"), (55, "t2é t3"), (None, "t5 t6")]
    assert got(spark, docs, queries, 10) == plainly(docs, queries, 10)


def test_repeated_rows_and_few_documents(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "c"), (3, "a"), (4, "d e"), (5, "f")]
    queries = [(1, "a"), (1, "a"), (2, "a c")]
    assert got(spark, docs, queries, 3) == plainly(docs, queries, 3)


def test_odd_rows(spark, odd_docs, no_docs):
    queries = spark.createDataFrame([(1, "one TWO w17")], "item_id long, text string")
    out = search(odd_docs, queries).collect()
    assert [r["rank"] for r in out] == list(range(1, len(out) + 1)) and {7, 9, 6} <= {r["doc_id"] for r in out}
    assert search(no_docs, queries).count() == 0 and search(odd_docs, queries.limit(0)).count() == 0
