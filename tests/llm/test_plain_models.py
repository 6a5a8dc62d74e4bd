"""The two trained classifiers against plain loops: what they say, and the direction of a training step against differences of the loss."""

import math
import random

import numpy as np
import pyarrow as pa

from patchlight.llm import language, quality
from patchlight.llm import vectext as vt
from patchlight.llm.language import Network, Settings, identify, train


def plain_probabilities(net, window):
    """Each filter of each width at each place, one number at a time."""
    s, tops = net.settings, []
    most = max(s.widths)
    for f in range(len(net.bias)):
        width = s.widths[f // s.filters]
        best = -math.inf
        for at in range(len(window) - most + 1):
            best = max(best, sum(float(net.embed[window[at + k], e]) * float(net.bank[k * s.embedding + e, f]) for k in range(width) for e in range(s.embedding)))
        tops.append(max(best + float(net.bias[f]), 0.0))
    z = [sum(t * float(net.dense[f, c]) for f, t in enumerate(tops)) + float(net.offset[c]) for c in range(len(net.languages))]
    whole = sum(math.exp(x) for x in z)
    return [math.exp(x) / whole for x in z]


SMALL = Settings(window=12, widths=(2, 3), filters=2, embedding=3, epochs=1, batch=64)


def made_windows(n=10):
    rng = random.Random(2)
    x = np.array([[rng.choice(b"abcde" if k % 2 else b"vwxyz") for _ in range(SMALL.window)] for k in range(n)], np.uint8)
    return x, np.arange(n) % 2


def test_network_says_what_plain_loops_say():
    x, y = made_windows()
    net = train(x, y, ["p", "q"], SMALL)
    assert np.allclose(net.probabilities(x), [plain_probabilities(net, w) for w in x], atol=1e-5)


def test_network_steps_down_the_loss():
    x, y = made_windows()
    before, after = Network.fresh(SMALL, ["p", "q"]), train(x, y, ["p", "q"], SMALL)
    loss = lambda net: -sum(math.log(plain_probabilities(net, w)[t]) for w, t in zip(x, y, strict=True)) / len(x)
    checked = 0
    for name in ("embed", "bank", "dense", "offset"):
        table = getattr(before, name)
        for at in list(np.ndindex(table.shape))[:: max(table.size // 12, 1)] + ([(b, 0) for b in b"abvw"] if name == "embed" else []):
            held, sides = table[at], []
            for shift in (1e-3, -1e-3):
                table[at] = held + shift
                sides.append(loss(before))
            table[at] = held
            slope, moved = (sides[0] - sides[1]) / 2e-3, getattr(after, name)[at] - held
            # The first step of Adam moves every weight by the rate, against its slope.
            if abs(slope) > 1e-3:
                assert math.isclose(moved, -math.copysign(SMALL.rate, slope), rel_tol=1e-2), (name, at)
                checked += 1
            elif slope == 0:
                assert moved == 0
    assert checked > 12


def test_texts_are_judged_by_all_their_windows(spark, monkeypatch):
    x, y = made_windows()
    net = train(x, y, ["p", "q"], SMALL)
    monkeypatch.setattr(language, "_sample", lambda labelled, settings: (x, ["p", "q"] * 5))
    texts = ["abc", "vwxyz" * 9, "abcdevwxyz" * 7, "é" * 20, "1 2 3", None]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in identify(docs, docs, SMALL).collect():
        data = (texts[r["doc_id"]] or "").encode()
        parts = [data[i : i + SMALL.window] for i in range(0, len(data), SMALL.window)]
        if r["doc_id"] > 3:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        each = [(len(p), plain_probabilities(net, np.frombuffer(p.ljust(SMALL.window, b"\0"), np.uint8))) for p in parts]
        mean = [sum(n * p[c] for n, p in each) / len(data) for c in (0, 1)]
        assert r["lang_pred"] == "pq"[mean.index(max(mean))] and math.isclose(r["score"], max(mean), abs_tol=1e-5)


def plain_cumulative(weights, thresholds, buckets):
    """P(grade) from P(grade > k), one text at a time."""
    s = sum(float(weights[b]) for b in buckets)
    upto = [1 / (1 + math.exp(s - t)) for t in thresholds] + [1.0]
    return [b - a for a, b in zip([0.0, *upto], upto, strict=False)]


def graded():
    rng = random.Random(8)
    texts, target = [], []
    for k in range(60):
        g = k % 3
        w = [f"w{rng.randrange(30)}" for _ in range(12)] + [["vile", "dull", "fine"][g]] * (rng.random() < 0.8)
        texts.append(" ".join(w))
        target.append(g)
    found, where = quality.features(*vt.text_bytes(pa.array(texts)))
    return found, where, np.array(target)


def test_tails_are_those_of_plain_cumulative_logits():
    found, where, target = graded()
    model = quality.fit(found, where, target, [0, 1, 2], np.array([20.0, 20.0, 20.0]), quality.Settings(epochs=5))
    assert (np.diff(model.thresholds) > 0).all()
    for k, tails in enumerate(model.tails(found, where)):
        p = plain_cumulative(model.weights, model.thresholds, found[where[k] : where[k + 1]])
        assert np.allclose(tails, [p[1] + p[2], p[2]], atol=1e-9)
    sure = lambda w, t: sum(math.log(plain_cumulative(w, t, found[where[k] : where[k + 1]])[g]) for k, g in enumerate(target))
    assert sure(model.weights, model.thresholds) > sure(np.zeros_like(model.weights), np.log([0.5, 2.0])) + 10


def test_fit_steps_down_the_loss():
    found, where, target = graded()
    s = quality.Settings(epochs=1, batch=1000, sparsity=0.0)
    model = quality.fit(found, where, target, [0, 1, 2], np.array([20.0, 20.0, 20.0]), s)
    start, zero = np.log([0.5, 2.0]), np.zeros_like(model.weights)
    loss = lambda w: -sum(math.log(plain_cumulative(w, start, found[where[k] : where[k + 1]])[g]) for k, g in enumerate(target))
    checked = 0
    for b in np.unique(found)[::4]:
        sides = []
        for shift in (1e-4, -1e-4):
            zero[b] = shift
            sides.append(loss(zero))
        zero[b] = 0.0
        slope = (sides[0] - sides[1]) / 2e-4
        if abs(slope) > 0.1:
            assert math.isclose(model.weights[b], -math.copysign(s.rate, slope), rel_tol=1e-2)
            checked += 1
    assert checked > 8 and not model.weights[np.setdiff1d(np.arange(1000), found)].any()
