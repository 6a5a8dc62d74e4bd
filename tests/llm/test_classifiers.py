import random

from pyspark.sql import functions as F

from patchlight.llm.language import Settings, cut, identify
from patchlight.llm.quality import rate

import numpy as np

from .conftest import words

SYLLABLES = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["sch", "ung", "heit", "ver"], "cc": ["ét", "eau", "oi", "ère"]}


def sentences(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(k, sentences(rng, lang, rng.randrange(5, 200)), lang) for k, lang in enumerate(random.Random(1).choices(list(SYLLABLES), k=240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs.filter("doc_id >= 180").drop("lang"), docs.filter("doc_id < 180"), Settings(epochs=4)).collect()
    right = sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in got)
    assert len(got) == 60 and right >= 57 and all(0 <= r["score"] <= 1 for r in got)
    odd = identify(odd_docs.withColumnRenamed("key", "lang_pred"), docs, Settings(epochs=1))
    by = {r["doc_id"]: r for r in odd.collect()}
    assert odd.count() == odd_docs.count() and {by[k]["lang_pred"] for k in (3, 4, 5)} == {"und"} and by[3]["score"] == 0
    assert identify(no_docs, docs, Settings(epochs=1)).count() == 0
    assert {r["lang_pred"] for r in identify(docs, no_docs).collect()} == {"und"}


def test_windows_hold_the_whole_text():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    cuts, of, held = cut(data, np.array([0, 7, 7, 10]), 4)
    assert [w.tobytes().rstrip(b"\0") for w in cuts] == [b"abcd", b"efg", b"hij"] and of.tolist() == [0, 0, 2] and held.tolist() == [4, 3, 3]


def test_grades_order_texts(spark, odd_docs, no_docs):
    rng = random.Random(6)
    kinds = [["vile", "scum"], ["%%%", "|"], []]
    rows = []
    for k in range(600):
        w = words(rng, rng.randrange(20, 80)).split()
        for _ in range(3 if k % 3 < 2 else 0):
            w.insert(rng.randrange(len(w)), rng.choice(kinds[k % 3]))
        rows.append((k, " ".join(w), k % 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    ratings = docs.filter("doc_id < 450").select("doc_id", "grade")
    scored = rate(docs.select("doc_id", "text"), ratings)
    got = {r["grade"]: r["e"] for r in scored.filter("doc_id >= 450").join(docs.select("doc_id", "grade"), "doc_id").groupBy("grade").agg(F.avg("expected_grade").alias("e")).collect()}
    # A text without evidence gets the grades' own frequencies, here a third each, so good ones stay near the middle.
    assert got[0] < 0.5 and got[0] + 0.2 < got[1] < got[2]
    assert all(0 <= r["p_bottom"] <= 1 and 0 <= r["p_top"] <= 1 for r in scored.collect())
    assert rate(odd_docs.withColumnRenamed("key", "p_top"), ratings.filter("false")).filter("expected_grade = 0 and p_top = 1").count() == odd_docs.count()
    assert rate(odd_docs, odd_docs.select("doc_id", F.lit(1).alias("grade"))).filter("expected_grade = 1").count() == odd_docs.count()
    assert rate(no_docs, ratings).count() == 0
