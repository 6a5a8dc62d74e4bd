import random

import pytest
from pyspark.sql import functions as F

from patchlight.llm import mixing
from patchlight.llm.mixing import mix, targets


def test_targets_share_the_whole_below_the_caps(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(sizes, [5, 2, 1], 3).collect()}
    # By code point a, b, c, null weigh 5, 2, 1, 5; a, b and null meet their caps, c gets the rest.
    assert got == {"a": 300.0, "b": 30.0, None: 15.0, "c": 770.0}


def test_targets_without_a_cap_follow_the_weights(spark):
    sizes = spark.createDataFrame([("a", 500), ("b", 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(sizes, [5, 2, 1], 3).collect()}
    assert got["a"] == pytest.approx(1000 * 5 / 7) and got["b"] == pytest.approx(1000 * 2 / 7)


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))
    rows = mix(docs).collect()
    assert {(r["doc_id"], r["copies"]) for r in rows} == {(r["doc_id"], r["copies"]) for r in mix(docs.repartition(7)).collect()}
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


def test_odd_rows(odd_docs, no_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["size"] for r in rows if r["text"] is None} == {0}
    assert mix(no_docs).count() == 0
    again = mix(mix(odd_docs))
    assert again.columns == mix(odd_docs).columns


def test_a_cut_among_equal_places_divides_them(spark):
    rows = [(None, "w " * 10, "a", "x")] * 300 + [(1, "w " * 10, "b", "x")] * 40 + [(k, "v " * 5, "c", "x") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, head string")
    got = mix(docs).collect()
    assert mix(docs).columns[:4] == docs.columns
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5


def test_many_sources_mix_as_few_do(odd_docs, monkeypatch):
    few = sorted(map(str, mix(odd_docs).collect()))
    monkeypatch.setattr(mixing, "FEW_BYTES", -1)
    assert sorted(map(str, mix(odd_docs).collect())) == few


def test_ranges_of_sources_make_no_difference(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"s{k:04}" if k else None, rng.choice([0, 1, 5, 5, 40, 1000]) * rng.randrange(1, 4)) for k in range(400)]
    sizes = spark.createDataFrame(rows, "source string, source_size long")
    got = []
    for each in (1 << 16, 17):
        monkeypatch.setattr(mixing, "RANGE_ROWS", each)
        got.append({r["source"]: r["target"] for r in mixing.targets(sizes, (5, 2, 1), 3).collect()})
    assert got[0] == got[1] and len(got[0]) == 400
    total = sum(n for _, n in rows)
    assert abs(sum(got[0].values()) - total) < 1e-6 * total and all(got[0][s] <= 3 * n for s, n in rows)
