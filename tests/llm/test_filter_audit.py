import random
from itertools import permutations

import numpy as np

from patchlight.llm.filter_audit import audit, plain_changes, text_failures, walk

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def failures(rows):
    """Plainly: the set of failed filters of (doc_id, text) rows."""
    out = []
    for doc_id, text in rows:
        x = text or ""
        words = [w for w in "".join(" " if c in WHITE else c for c in x).split(" ") if w]
        caps = sum("A" <= c <= "Z" for c in x)
        copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == x for d, t in rows)
        out.append({f for f, no in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * caps > 10 * len(x), any(c in x for c in "#$%&*|"), copy), strict=True) if no})
    return out


def plainly(rows, parts, good, toxic):
    failed, out, shapley = failures(rows), {}, {}
    for part in {p or "" for p in parts}:
        for order in permutations("ABCDE"):
            left = [i for i, p in enumerate(parts) if (p or "") == part]
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failed[i]]
                here = [i for i, p in enumerate(parts) if (p or "") == part and f in failed[i]]
                left = [i for i in left if f not in failed[i]]
                out[part, "".join(order), step] = [len(left), len(gone), len(here) - len(gone), sum(failed[i] == {f} for i in here), sum(good[i] for i in gone), sum(toxic[i] for i in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_plain_changes_meet_every_order_once():
    for k in (1, 2, 3, 5):
        order, met = list(range(k)), [tuple(range(k))]
        for i in plain_changes(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            met.append(tuple(order))
        assert len(met) == len(set(met)) and set(met) == set(permutations(range(k)))


def test_walk_matches_cells():
    rng = np.random.default_rng(5)
    masks, counts = np.arange(8), rng.integers(0, 50, (8, 2))
    orders, removed, redundant, shapley = walk(3, masks, counts)
    sums = dict.fromkeys(range(3), 0)
    for o, out, again in zip(orders, removed, redundant, strict=True):
        before = 0
        for s, f in enumerate(o):
            here = [m for m in masks if m >> f & 1]
            assert list(out[s]) == list(sum((counts[m] for m in here if not m & before), np.zeros(2, int)))
            assert again[s] == sum(counts[m, 0] for m in here if m & before)
            sums[f] += out[s, 0]
            before |= 1 << f
    assert [sums[f] for f in range(3)] == list(shapley)


def test_audit_matches_plain_loops(spark):
    rng = random.Random(7)
    pool = [" ".join(f"w{rng.randrange(1000)}" for _ in range(n)) for n in (120, 120, 40)] + ["a b " * 80, "X" * 30, "# " + "u v w\x0bx " * 50, "", None, " \t", "ÉTÉ \U0001f600|", "w " * 20_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(pool)) for _ in range(150)]
    rows += rows[:3]
    parts = [rng.choice(["en", "de", None, ""]) for _ in rows]
    good, toxic = [rng.random() < 0.5 for _ in rows], [rng.random() < 0.3 for _ in rows]
    docs = spark.createDataFrame([(*r, p, "x", "y") for r, p in zip(rows, parts, strict=True)], "doc_id long, text string, lang string, words string, digest string")
    failed = text_failures(docs)
    got = sorted(map(str, ((r["doc_id"], r["part"], "".join(f for f, c in zip("ABCDE", ("short", "poor", "loud", "symbols", "copy"), strict=True) if r[c])) for r in failed.collect())))
    assert got == sorted(map(str, ((d, p, "".join(sorted(f))) for (d, _), p, f in zip(rows, parts, failures(rows), strict=True))))
    flags = [(p, *(f in x for f in "ABCDE"), g, t) for p, x, g, t in zip(parts, failures(rows), good, toxic, strict=True)]
    cols = "lang string, a boolean, b boolean, c boolean, d boolean, e boolean, good boolean, toxic boolean"
    out = audit(spark.createDataFrame(flags, cols), "lang", dict(zip("ABCDE", "abcde", strict=True)), ["good", "toxic"])
    mine = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in out.collect()}
    assert mine == plainly(rows, parts, good, toxic)


def test_odd_rows(spark, odd_docs, no_docs):
    failed = text_failures(odd_docs)
    assert failed.count() == odd_docs.count()
    by = {(r["doc_id"], r["part"]): r for r in failed.collect()}
    assert not by[1, "en"]["copy"] and by[4, None]["copy"] and not by[3, "en"]["copy"]
    assert audit(failed, "part", {"A": "short", "E": "copy"}, []).count() == 4 * 2 * 2
    assert audit(text_failures(no_docs), "part", {"A": "short"}, []).count() == 0
