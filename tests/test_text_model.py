import math
import random
import re

import numpy as np

from patchlight.jobs import queries as q
from patchlight.operators import text_model
from patchlight.operators.text_model import Settings, fit, minimised, packed, sampled, terms


def made(n, seed=1):
    """Texts whose label a few words give away, most of the time."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        y = rng.random() < 0.4
        words = [f"w{rng.randrange(14)}" for _ in range(rng.randrange(3, 20))]
        if rng.random() < 0.9:
            words.insert(rng.randrange(len(words)), "overflow guard" if y else "typo fix")
        out.append((k, " ".join(words), float(y), rng.random()))
    return out


def plain_terms(text):
    words = re.findall(r"\b\w\w+\b", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def test_terms_are_words_and_pairs(spark):
    rows = spark.createDataFrame([("One two, a THREE",), ("solo",), ("",), (None,), ("É1 x",)], "t string")
    got = [r["n"] for r in rows.selectExpr("t").withColumn("n", q.F.size(terms(q.F.col("t"), 1 << 20))).collect()]
    assert got == [len(plain_terms(t)) for t in ("One two, a THREE", "solo", "", None, "É1 x")] == [5, 1, 0, 0, 1]


def test_the_minimum_is_found():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 8))
    m, b = a.T @ a + np.eye(8), rng.normal(size=8)
    x = minimised(lambda x: (float(x @ m @ x / 2 - b @ x), m @ x - b), np.zeros(8), 200)
    assert np.allclose(x, np.linalg.solve(m, b), atol=1e-4)


def test_fit_equals_a_plain_fit(spark):
    """Newton's method on dense vectors, over terms instead of places (of which there are so many that hardly two share one)."""
    rows = made(120)
    settings = Settings(places=1 << 18, least_df=2, strength=5.0, tasks=3, steps=200)
    model = fit(spark.createDataFrame(rows, "k int, t string, y double, w double"), "t", "y", "w", settings)
    counts = [{t: plain_terms(x).count(t) for t in plain_terms(x)} for _, x, _, _ in rows]
    df = {t: sum(t in c for c in counts) for c in counts for t in c}
    names = sorted(t for t, n in df.items() if n >= 2)
    dense = np.array([[(1 + math.log(c[t])) * (math.log(121 / (1 + df[t])) + 1) if t in c else 0.0 for t in names] for c in counts])
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    x, y, w = np.hstack([dense, np.ones((120, 1))]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    pull = np.append(np.ones(len(names)), 0.0)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(5 * (x.T * (w * p * (1 - p))) @ x + np.diag(pull), 5 * x.T @ (w * (p - y)) + pull * beta)
    want = 1 / (1 + np.exp(-x @ beta))
    tested = model.probability(spark.createDataFrame(rows, "k int, t string, y double, w double"), "t", "p")
    got = {r["k"]: r["p"] for r in tested.collect()}
    assert tested.columns == ["k", "t", "y", "w", "p"]
    assert max(abs(got[k] - want[k]) for k in got) < 5e-3
    fresh = {r["k"]: (r["p"], r["y"]) for r in model.probability(spark.createDataFrame(made(200, 2), "k int, t string, y double, w double"), "t", "p").collect()}
    assert sum((p >= 0.5) == (y == 1) for p, y in fresh.values()) > 160


def test_odd_rows(spark):
    kind = "t string, y double, w double"
    rows = spark.createDataFrame([(None, 1.0, 1.0), ("", 0.0, None), ("a b", 1.0, 0.0), ("good word", 1.0, 1.0)], kind)
    for taught in (rows, rows.limit(0)):
        out = fit(taught, "t", "y", "w", Settings(places=64, least_df=1, steps=5, tasks=2)).probability(rows, "t", "p").collect()
        assert len(out) == 4 and all(0 < r["p"] < 1 for r in out)


def test_a_bounded_sample_is_learned_from(spark):
    rows = spark.range(3000).selectExpr("cast(id as string) AS t", "cast(id % 3 = 0 as double) AS y")
    got = sampled(rows, "y", "t", 40)
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {0.0: 40, 1.0: 40}
    assert sorted(r["t"] for r in got.collect()) == sorted(r["t"] for r in sampled(rows.repartition(7), "y", "t", 40).collect())
    assert sampled(rows, "y", "t", 10_000).count() == 3000


def test_only_a_labels_last_rows_are_ranked(spark):
    """All of a label's texts don't meet in one task: the rank is over those that share the first bits of its last one."""
    rows = spark.range(20_000).selectExpr("cast(id as string) AS t", "0.0D AS y")
    got = sampled(rows, "y", "t", 5000)
    heads = got.select(q.F.shiftrightunsigned(q.F.xxhash64("t"), 48).alias("h")).collect()
    every = sorted(r["h"] for r in rows.select(q.F.shiftrightunsigned(q.F.xxhash64("t"), 48).alias("h")).collect())
    assert sorted(r["h"] for r in heads) == every[:5000]
    assert got.rdd.getNumPartitions() >= rows.rdd.getNumPartitions()


def test_all_rows_are_learned_from(spark):
    """120,000 rows of a label, of which 100 hold a word: its weight says of how many rows it is in."""
    rows = spark.range(120_000).selectExpr("CASE WHEN id % 1200 = 7 THEN 'rare word' ELSE 'usual' END AS t", "1.0D AS y", "1.0D AS w")
    model = fit(rows, "t", "y", "w", Settings(steps=0))
    (place,) = spark.range(1).select(terms(q.F.lit("rare"), 1 << 16).alias("p")).first()["p"]
    assert abs(model.idf[place] - (math.log(120_001 / 101) + 1)) < 1e-9


def test_steps_read_counts_not_terms(spark):
    rows = spark.createDataFrame([([3, 1, 3], 1.0, 0.5), ([], 0.0, 0.0), ([2], 0.0, 1.0)], "terms array<int>, y double, w double").coalesce(1)
    (r,) = packed(rows).collect()
    read = {c: np.frombuffer(r[c], t).tolist() for c, t in text_model._TYPES.items()}
    assert read == {"y": [1.0, 0.0, 0.0], "w": [0.5, 0.0, 1.0], "lengths": [2, 0, 1], "places": [1, 3, 2], "counts": [1, 2, 1]}


def test_the_query_beats_the_larger_label(spark):
    row = q.text_classifier(spark, "/root/testdata/sf0.01").first()
    assert row["tested"] > 100 and row["accuracy"] > row["majority"] + 0.1
