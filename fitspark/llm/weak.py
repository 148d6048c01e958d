"""Weak supervision: reliabilities of labelers by expectation-maximisation over counts of vote patterns.

A vote is 1, 0 or -1 for abstaining. The table is only aggregated to how often
each pattern of votes occurs, which is all that the estimates depend on; with k
labelers that is at most 3**k rows, whatever the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Reliability:
    """The prior of class 1 and, for each labeler, P(vote | class) as [class][vote + 1]."""

    prior: float
    table: np.ndarray

    def weights(self) -> tuple[float, np.ndarray]:
        """The log-odds of class 1 are the first number plus the weight of each labeler's vote."""
        t = np.log(self.table[:, 1]) - np.log(self.table[:, 0])
        return math.log(self.prior / (1 - self.prior)), t

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        bias, w = self.weights()
        z = bias + sum(w[j][votes[:, j] + 1] for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def posterior_column(self, votes: list[Column]) -> Column:
        bias, w = self.weights()
        z = F.lit(float(bias))
        for v, of in zip(votes, w):
            z = z + F.when(v == 1, float(of[2])).when(v == 0, float(of[1])).otherwise(float(of[0]))
        return 1 / (1 + F.exp(-z))


def estimate(votes: np.ndarray, counts: np.ndarray, *, prior: float = 0.5, rounds: int = 200, abstain_tells: bool = False, fix_prior: bool = False) -> Reliability:
    """Dawid and Skene's estimates for two classes, from patterns and their counts.

    It starts from the share of positive votes. Abstaining tells nothing about the
    class unless `abstain_tells`. Add-one smoothing keeps rates off 0 and 1, and a
    labeler is never taken to be worse than chance. Without patterns: the prior.
    """
    k = votes.shape[1]
    even = np.full((k, 2, 3), 1 / 3)
    if not len(votes):
        return Reliability(prior, even)
    counts = counts.astype(np.float64)
    said = (votes >= 0).sum(1)
    q = np.where(said > 0, ((votes == 1).sum(1) + prior) / (said + 1), prior)
    table, p = even, prior
    for _ in range(rounds):
        for j in range(k):
            rows = np.array([[((counts * c)[votes[:, j] == v]).sum() + 1 for v in (-1, 0, 1)] for c in (1 - q, q)])
            spoke = rows[:, 1:].sum(1)
            right = np.array([rows[0, 1], rows[1, 2]]) / spoke
            right = np.clip(right, 0.01, 0.99)
            if right.sum() < 1:  # worse than chance
                right = np.array([0.5, 0.5])
            silent = rows[:, 0] / rows.sum(1) if abstain_tells else np.full(2, rows[:, 0].sum() / rows.sum())
            table = table.copy()
            table[j, 0] = [silent[0], (1 - silent[0]) * right[0], (1 - silent[0]) * (1 - right[0])]
            table[j, 1] = [silent[1], (1 - silent[1]) * (1 - right[1]), (1 - silent[1]) * right[1]]
        if not fix_prior:
            p = float(np.clip((counts @ q + 1) / (counts.sum() + 2), 0.001, 0.999))
        new = Reliability(p, table).posterior(votes)
        if np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    return Reliability(p, table)


def logistic(features: np.ndarray, target: np.ndarray, counts: np.ndarray, *, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, by Newton steps; the first column is the constant."""
    w = np.zeros(features.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (counts * (p - target)) + penalty * w
        hess = (features * (counts * p * (1 - p))[:, None]).T @ features + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
