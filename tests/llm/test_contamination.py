import random

from patchlight.llm.contamination import contained_items

from .conftest import words

ITEMS = "item_id long, text string, doc_id long"


def brute(docs, items):
    def cut(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({("only", *w)} if w else set())

    held, wanted = {}, {}
    for k, t in docs:
        held.setdefault(k, set()).update(cut(t))
    for k, t in items:
        wanted.setdefault(k, set()).update(cut(t))
    return {(d, i): len(x & y) for d, x in held.items() if d is not None for i, y in wanted.items() if i is not None and y and len(x & y) >= 0.8 * len(y)}


def test_items_are_found_wherever_they_stand(spark):
    rng = random.Random(8)
    items = [(k, words(rng, rng.choice([3, 5, 9, 20, 40, 90]), 10**6)) for k in range(40)] + [(3, words(rng, 12, 10**6)), (None, "null id here it is"), (50, None), (51, "")]
    docs = []
    for k in range(120):
        parts = [words(rng, rng.randrange(0, 900), 10**6)]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items[:40])[1].upper().split()
            if rng.random() < 0.5 and len(w) > 15:
                w[-1] = "changed"
            parts += [" ".join(w), words(rng, rng.randrange(0, 300), 10**6)]
        docs.append((k, "\n".join(parts)))
    docs += [(200, items[0][1]), (201, None), (202, ""), (None, items[5][1]), (7, items[9][1])]
    docs.append((300, words(rng, 30_000, 10**6) + " " + items[7][1] + " " + words(rng, 9000, 10**6)))
    got = contained_items(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in got} == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two", 0)], ITEMS)
    assert {r["doc_id"] for r in contained_items(odd_docs, items).collect()} == {7, 9}
    assert contained_items(no_docs, items).count() == 0
    assert contained_items(odd_docs, items.limit(0)).count() == 0


def test_tiny_items_inside_many_long_texts(spark):
    rng = random.Random(4)
    items = [(k, f"t{k} u{k} v{k} w{k} x{k}" + (" y" if k % 3 else "")) for k in range(12)]
    docs = [(k, words(rng, 200, 10**6) + " " + items[k % 12][1] + " " + words(rng, 200, 10**6)) for k in range(300)]
    found = contained_items(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, h string"), spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k % 12) for k in range(300)}
