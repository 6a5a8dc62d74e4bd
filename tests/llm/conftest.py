import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and a column named as operators' own are."""
    rng = random.Random(3)
    long = words(rng, 30_000)
    base = words(rng, 60)
    rows = [
        (1, base, "en", "a", 10, "x"),
        (1, base, "en", "a", 10, "x"),
        (2, base.upper(), "en", None, None, None),
        (3, None, "en", "b", 0, "x"),
        (4, "", None, "b", 0, "x"),
        (5, " \t\n ", "de", "b", 0, "x"),
        (None, base + " tail", None, "a", 1, "x"),
        (6, long, "de", "c", 1, "x"),
        (7, "one two", "de", "c", 1, "x"),
        (8, "ONE\u00a0two", "de", "c", 1, "x"),
        (9, "one\ntwo", "de", "c", 1, "x"),
        (10, "x" * 200_000, "de", "c", 1, "x"),
        (11, "\u00c9t\u00e9 \U0001f600 !!", "fr", "c", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
