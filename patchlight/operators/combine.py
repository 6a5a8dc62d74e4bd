"""Votes combined: majority, patterns, and a generative label model whose statistics Spark gathers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staged import staged

#: No probability of a vote leaves this far from 0 and 1.
CLIP = 1e-6


def n_votes(lfs: Sequence[str], vote: int) -> Column:
    return sum((F.when(F.col(c) == vote, 1).otherwise(0) for c in lfs), F.lit(0))


def majority(lfs: Sequence[str]) -> Column:
    """1 or 0, whichever has more votes; -1 for a tie or no vote."""
    yes, no = n_votes(lfs, 1), n_votes(lfs, 0)
    return F.when(yes > no, 1).when(no > yes, 0).otherwise(-1).cast("tinyint")


def patterns(votes: DataFrame, lfs: Sequence[str]) -> DataFrame:
    """Distinct combinations of votes with how often each occurs, ``n``. Partial sums leave few rows to shuffle."""
    return votes.groupBy(*lfs).agg(F.count(F.lit(1)).alias("n"))


def moments(votes: DataFrame, lfs: Sequence[str], weight: str | None = None) -> tuple[np.ndarray, float]:
    """E[l l^T] of the indicators "function j votes y", in the order (0: no, 0: yes, 1: no, ...), and the number of rows.

    One pass of sums over the upper triangle, so (2m)^2 / 2 numbers reach the driver however many rows or patterns there are.
    """
    w = F.col(weight) if weight else F.lit(1)
    on = [(F.col(c) == y).cast("double") * w for c in lfs for y in (0, 1)]
    is_on = [F.col(c) == y for c in lfs for y in (0, 1)]
    m = len(on)
    sums = [F.sum(F.when(is_on[j], on[i])).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m) if i // 2 != j // 2 or i == j]
    row = votes.agg(F.sum(w).cast("double").alias("total"), *sums).first()
    total = row["total"] or 0.0
    out = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            if i // 2 != j // 2 or i == j:
                out[i, j] = out[j, i] = (row[f"s{i}_{j}"] or 0.0) / max(total, 1.0)
    return out, total


@dataclass
class LabelModel:
    """P(vote of function j is y | class), one row per (function, y) and one column per class (0, 1), and the class prior."""

    lfs: list[str]
    mu: np.ndarray
    prior: np.ndarray

    @classmethod
    def fit(cls, observed: np.ndarray, lfs: Sequence[str], prior: float | None = None, *, epochs: int = 500, rate: float = 0.01, seed: int = 42) -> LabelModel:
        """Match the second moments off the functions' own blocks, and the first on the diagonal, by full-batch gradient steps.

        prior: share of class 1; uniform if None. Functions start better than chance, as the seed says by how much.
        """
        m = len(lfs)
        p = np.array([1 - prior, prior]) if prior is not None else np.array([0.5, 0.5])
        rates = np.diag(observed)
        rng = np.random.default_rng(seed)
        lift = rng.uniform(0.6, 0.8, m)
        mu = np.empty((2 * m, 2))
        for y in (0, 1):
            own = np.where(np.arange(2) == y, lift[:, None], 1 - lift[:, None])
            mu[y::2] = rates[y::2, None] * own / (own @ p)[:, None]
        mu = np.clip(mu, CLIP, 1 - CLIP)
        block = np.arange(2 * m) // 2
        mask = (block[:, None] != block[None]).astype(float)
        first, second, step = np.zeros_like(mu), np.zeros_like(mu), 0
        for _ in range(epochs):
            gap = mask * (observed - (mu * p) @ mu.T)
            slope = -4 * (gap @ mu) * p - 2 * np.outer(rates - mu @ p, p)
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            pace = rate * np.maximum(rates, 1e-4)[:, None]
            mu = np.clip(mu - pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-12), CLIP, 1 - CLIP)
        return cls(list(lfs), mu, p)

    def accuracies(self) -> list[tuple[str, float]]:
        """P(class is the one voted for | the function votes)."""
        right = self.mu[0::2, 0] * self.prior[0] + self.mu[1::2, 1] * self.prior[1]
        cast = (self.mu @ self.prior).reshape(-1, 2).sum(1)
        return [(c, float(a)) for c, a in zip(self.lfs, right / np.maximum(cast, CLIP), strict=True)]

    def posterior(self) -> Column:
        """P(class 1 | votes): the prior's and each cast vote's log odds, added up. An abstention adds nothing."""
        odds = np.log(self.mu[:, 1]) - np.log(self.mu[:, 0])
        score = F.lit(float(np.log(self.prior[1] / self.prior[0])))
        for j, c in enumerate(self.lfs):
            score = score + F.when(F.col(c) == 0, float(odds[2 * j])).when(F.col(c) == 1, float(odds[2 * j + 1])).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))

    def label(self, probability: Column, threshold: float) -> Column:
        """1 from the threshold on, else 0; -1 where no function votes."""
        cast = n_votes(self.lfs, 0) + n_votes(self.lfs, 1)
        return F.when(cast == 0, -1).when(probability >= threshold, 1).otherwise(0).cast("tinyint")


def sliced(observed: np.ndarray, all_lfs: Sequence[str], lfs: Sequence[str]) -> np.ndarray:
    """The moments of some functions, out of those of all."""
    at = [2 * all_lfs.index(c) + y for c in lfs for y in (0, 1)]
    return observed[np.ix_(at, at)]


def fit_label_model(votes: DataFrame, lfs: Sequence[str], prior: float | None = None, *, weight: str | None = None, **settings) -> LabelModel:
    observed, _ = moments(votes, lfs, weight)
    return LabelModel.fit(observed, lfs, prior, **settings)


def ablated(votes: DataFrame, lfs: Sequence[str], subsets: Mapping[str, Sequence[str]], prior: float, gold: str) -> DataFrame:
    """The model fitted to each subset of the functions: rows ``flagged`` by it and those of them that are ``gold``, by ``subset``.

    The moments of a subset are a part of those of all functions, so they are summed once, and one pass over the patterns scores all refits.
    """
    counted = staged(votes.groupBy(*lfs, F.coalesce(F.col(gold), F.lit(False)).alias("gold")).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    observed, _ = moments(counted, lfs, "n")
    sums = []
    for k, own in enumerate(subsets.values()):
        model = LabelModel.fit(sliced(observed, lfs, own), own, prior)
        flagged = model.label(model.posterior(), prior) == 1
        sums += [F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(f"{c}{k}") for c, x in (("f", flagged), ("g", flagged & F.col("gold")))]
    rows = [F.struct(F.lit(name).alias("subset"), F.col(f"f{k}").alias("flagged"), F.col(f"g{k}").alias("gold")) for k, name in enumerate(subsets)]
    return counted.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def with_labels(votes: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Adds ``prob_security``, ``label`` (-1 where nothing votes) and ``mv_label``."""
    scored = votes.withColumn("prob_security", model.posterior())
    return scored.withColumns({"label": model.label(F.col("prob_security"), threshold), "mv_label": majority(model.lfs)})
