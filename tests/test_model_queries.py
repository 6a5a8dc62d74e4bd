"""The queries on the label model, against plain loops over its fitted parameters."""

import math
from collections import Counter

import numpy as np
import pytest

from patchlight.jobs import fixtures as fx
from patchlight.jobs import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in fx.vote_matrix(spark, SF).collect()]


def plain_moments(rows, lfs):
    """Shares of rows on which two functions cast two votes, counted row by row; blocks of one function only on the diagonal."""
    seen = np.zeros((2 * len(lfs), 2 * len(lfs)))
    for r in rows:
        on = [2 * j + r[c] for j, c in enumerate(lfs) if r[c] in (0, 1)]
        for i in on:
            for j in on:
                seen[i, j] += 1
    return seen / len(rows)


def plain_model(rows, lfs, prior):
    return q.combine.LabelModel.fit(plain_moments(rows, lfs), lfs, prior)


def judged(row, model, lfs, prior):
    """Probability and label of one row by Bayes' rule on its cast votes."""
    one, two, cast = prior, 1 - prior, 0
    for j, c in enumerate(lfs):
        if row[c] in (0, 1):
            one, two, cast = one * model.mu[2 * j + row[c], 1], two * model.mu[2 * j + row[c], 0], cast + 1
    p = one / (one + two)
    return p, -1 if not cast else int(p >= prior)


@pytest.fixture(scope="module")
def scored(rows):
    """(order, line, probability, label, majority) of each row; the keys of the given table repeat."""
    model = plain_model(rows, q.VOTES, q.PRIOR)
    out = []
    for r in rows:
        yes, no = (sum(r[c] == v for c in q.VOTES) for v in (1, 0))
        out.append((r["l_orderkey"], r["l_linenumber"], *judged(r, model, q.VOTES, q.PRIOR), 1 if yes > no else 0 if no > yes else -1))
    return sorted(out)


def test_every_row_has_the_posterior_of_its_votes(spark, scored):
    got = sorted(map(tuple, q.label_model(spark, SF).select("l_orderkey", "l_linenumber", "prob_security", "label", "mv_label").collect()))
    assert len(got) == len(scored)
    assert np.allclose(np.array(got, float), np.array(scored, float), atol=1e-6)


def test_accuracies_are_shares_of_right_votes(spark, rows):
    model = plain_model(rows, q.VOTES, q.PRIOR)
    got = {r["lf"]: r["accuracy"] for r in q.lf_accuracies(spark, SF).collect()}
    assert list(got) == q.VOTES
    for j, c in enumerate(q.VOTES):
        no, yes = model.mu[2 * j], model.mu[2 * j + 1]
        right, cast = no[0] * (1 - q.PRIOR) + yes[1] * q.PRIOR, (no + yes) @ [1 - q.PRIOR, q.PRIOR]
        assert math.isclose(got[c], right / cast, abs_tol=1e-6)


def test_the_most_confident_come_first(spark, scored):
    got = [tuple(r) for r in q.top_confident(spark, SF).select("l_orderkey", "l_linenumber", "prob_security").collect()]
    best = sorted((-round(p, 9), order, line) for order, line, p, label, _ in scored if label == 1)[:15]
    assert [(order, line) for order, line, _ in got] == [(order, line) for _, order, line in best]
    assert np.allclose([p for *_, p in got], [-p for p, *_ in best], atol=1e-6)


def test_ablations_refit_each_subset(spark, rows):
    got = {r["subset"]: (r["flagged"], r["gold"]) for r in q.ablations(spark, SF).collect()}
    subsets = {"all": q.VOTES, "positives and one": [*q.POSITIVE, q.NEGATIVE[0]]} | {f"without {c}": [x for x in q.VOTES if x != c] for c in q.POSITIVE}
    assert set(got) == set(subsets)
    for name, lfs in subsets.items():
        model = plain_model(rows, lfs, q.PRIOR)
        flagged = [r["is_gold"] for r in rows if judged(r, model, lfs, q.PRIOR)[1] == 1]
        assert got[name] == (len(flagged), Counter(flagged)[True])


def test_review_sample_holds_labelled_rows_by_probability(spark, scored):
    got = [(r["sha"], round(r["prob_security"], 6)) for r in q.review_sample(spark, SF).filter("verdict = ''").collect()]
    flagged = Counter((f"{order}-{line}", round(float(p), 6)) for order, line, p, label, _ in scored if label == 1)
    assert len(got) == min(50, flagged.total()) and not Counter(got) - flagged
    assert [p for _, p in got] == sorted((p for _, p in got), reverse=True)
