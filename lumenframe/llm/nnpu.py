"""Non-negative positive-unlabelled learning of a logistic model over sparse binary features.

The risk of a scorer z is  pi * Rp(+) + max(0, Ru(-) - pi * Rp(-)):  the loss of
trusted positives taken as positive, and the loss of unlabelled rows taken as
negative less the part that positives hidden among them cause.  That second part
estimates the risk of the true negatives, so it may not fall below zero; a step
that finds it below zero climbs out instead of descending further.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class SparseRows:
    """Rows of feature indices, one after another."""

    indices: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> SparseRows:
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
        return SparseRows(flat, lengths)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.bincount(owner, weights[self.indices], len(self.lengths))

    def spread(self, per_row: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.indices, np.repeat(per_row, self.lengths), dim)


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray
    bias: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(z + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(positive: SparseRows, unlabelled: SparseRows, dim: int, prior: float, *, l2: float = 1e-4, steps: int = 300, rate: float = 0.1) -> LinearModel:
    """Full-batch Adam, so that the result depends on the rows only.

    Without positives or unlabelled rows the model says the prior for every text.
    """
    prior = float(min(max(prior, 1e-3), 1 - 1e-3))
    w, b = np.zeros(dim), float(np.log(prior / (1 - prior)))
    n_p, n_u = len(positive.lengths), len(unlabelled.lengths)
    if not n_p or not n_u:
        return LinearModel(w, b)
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        z_p, z_u = positive.sums(w) + b, unlabelled.sums(w) + b
        negative_risk = softplus(z_u).mean() - prior * softplus(z_p).mean()
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        g_neg_p, g_neg_u = -prior * s_p / n_p, s_u / n_u
        g_pos_p = -prior * (1 - s_p) / n_p
        if negative_risk < 0:
            d_p, d_u = -g_neg_p, -g_neg_u
        else:
            d_p, d_u = g_pos_p + g_neg_p, g_neg_u
        grad = np.empty(dim + 1)
        grad[:dim] = positive.spread(d_p, dim) + unlabelled.spread(d_u, dim) + l2 * w
        grad[dim] = d_p.sum() + d_u.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:dim], b - step[dim]
    return LinearModel(w, float(b))
