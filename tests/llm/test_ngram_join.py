import random

import numpy as np
import pytest

from patchlight.llm import ngram_join, trie
from patchlight.llm.graph import components
from patchlight.llm.ngram_join import ngram_groups
from patchlight.llm.trie import similar_pairs

from .conftest import words


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({("only", *w)} if w else set()))
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None, len(links[i])))
    return sorted(out, key=str)


def corpus(seed):
    """Exact and near copies, a hub that its copies resemble but they don't resemble each other, and passages that many share."""
    rng = random.Random(seed)
    rows, passage = [], words(rng, 60)
    for g in range(6):
        base = words(rng, 120, 5000).split()
        for _ in range(rng.randrange(1, 30)):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [words(rng, 40, 5000) + " " + passage for _ in range(60)] + [words(rng, rng.randrange(0, 9), 3) for _ in range(40)]
    rng.shuffle(rows)
    return [(k * 7 % 1009, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "size", "percent", "chunk"), [(1, 5, 80, 1 << 17), (2, 4, 85, 700)])
def test_groups_match_brute_force(spark, monkeypatch, seed, size, percent, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "HOT_CLASSES", 10 if chunk == 700 else 64)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = [tuple(r) for r in ngram_groups(docs, shingle_words=size, percent=percent).collect()]
    assert sorted(got, key=str) == brute(rows, size, percent)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [tuple(r) for r in ngram_groups(odd_docs).collect()]
    assert sorted(got, key=str) == brute(rows, 5, 80)
    assert ngram_groups(no_docs).count() == 0


def test_trie_join_matches_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(60):
        sets = {tuple(np.unique(rng.integers(0, 60, rng.integers(1, 40)))) for _ in range(rng.integers(2, 30))}
        sets = [np.array(s, np.uint64) for s in sets]
        percent = (50, 80, 100)[trial % 3]
        want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        pairs = [(max(p), min(p)) for p in [p for a, b in similar_pairs(sets, percent) for p in zip(a.tolist(), b.tolist(), strict=True)]]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_trie_join_by_groups_and_sides(monkeypatch):
    monkeypatch.setattr(trie, "STEP", 7)
    monkeypatch.setattr(trie, "CELLS", 200)
    rng = np.random.default_rng(6)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30))).astype(np.uint64) for _ in range(25)]
        groups, side = rng.integers(0, 4, 25), rng.integers(1, 3, 25)
        good = lambda i, j: groups[i] == groups[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))  # noqa: B023, E731
        weigh = lambda tokens: tokens % np.uint64(3)
        found = lambda **k: sorted(p for a, b in similar_pairs(sets, 60, groups=groups, weigh=weigh, **k) for p in zip(a.tolist(), b.tolist(), strict=True))  # noqa: B023, E731
        assert sorted((max(p), min(p)) for p in found()) == [(i, j) for i in range(25) for j in range(i) if good(i, j)]
        assert found(indexed=side == 1, asked=side == 2) == [(i, j) for i in range(25) for j in range(25) if side[i] == 2 and side[j] == 1 and good(i, j)]


def test_least_follows_links():
    rng = np.random.default_rng(7)
    for _ in range(20):
        pairs, least = rng.integers(0, 60, (40, 2)), trie.Least(60)
        for part in np.split(pairs, 4):
            least.link(part[:, 0], part[:, 1])
        want = np.arange(60)
        for _ in range(60):
            for a, b in pairs:
                want[a] = want[b] = min(want[a], want[b])
        assert (least.of == want).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)] + [(5, 5), (300, 299), (299, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[200 + k] for k in range(30)} == {100} and got[300] == got[299] == 299
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
