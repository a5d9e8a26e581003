"""Linear support vector classes with probabilities: a machine for each pair of classes, all fitted in the same passes.

Every machine minimises half its squared weights plus C times the weighted hinge losses.  The
hinge's corner is rounded over ROUND, so the losses have gradients; L-BFGS steps of all
machines (of all pairs, of the cross-fitting folds, and of several settings, as a search
asks for) share one pass over the rows, which returns each machine's loss and gradient at
STEPS lengths of its step; each takes the longest that lowers its loss enough.  Sums are
added up by Spark; the driver holds the machines, whose size is pairs times features.

A pair's probability is a sigmoid of its margin, fitted by Newton's method on margins of
machines that didn't see the row (FOLDS folds by a hash of the key).  The pairs' probabilities
are coupled into one distribution by the least squares of their disagreements.  The prediction is
the class that most pairs vote for, the smallest such one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.boosting import dense
from lumenframe.operators.summed import held, totals

FOLDS, ROUND, PASSES, MEMORY = 5, 0.05, 60, 8
STEPS = np.array([1.0, 0.25, 0.05])
#: Steps in a row that may fail, each after the first along the gradient and a tenth as long as the one before.
FAILURES = 4
#: Machines of a pair whose sums travel together, and rows that are multiplied at a time.
BLOCK, ROWS = 64, 2048


@dataclass(frozen=True)
class Settings:
    c: float = 1.0
    tol: float = 1e-3


@dataclass
class Svc:
    """Pairs (a, b) of classes: a positive margin x . w + bias speaks for a, with probability 1 / (1 + exp(slope * margin + offset))."""

    n_classes: int
    pairs: np.ndarray
    w: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    offset: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w.T + self.bias

    def votes(self, margins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(margins), self.n_classes))
        for j, (a, b) in enumerate(self.pairs):
            out[:, a] += margins[:, j] > 0
            out[:, b] += margins[:, j] <= 0
        return out.argmax(axis=1)

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        r = np.clip(_sigmoid(-(self.slope * margins + self.offset)), 1e-7, 1 - 1e-7)
        return coupled(r, self.pairs, self.n_classes)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with probability and prediction."""
        model, width = self, self.w.shape[1]

        @F.pandas_udf("struct<p: array<double>, y: double>")
        def said(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in batches:
                m = model.margins(np.array(s.to_list(), float).reshape(len(s), width))
                yield pd.DataFrame({"p": list(model.probabilities(m)), "y": model.votes(m).astype(float)})

        out = df.withColumn("__said", said(vector_to_array("features")))
        return out.withColumns({"probability": array_to_vector("__said.p"), "prediction": F.col("__said.y")}).drop("__said")


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * v))


def coupled(r: np.ndarray, pairs: np.ndarray, n_classes: int) -> np.ndarray:
    """Class probabilities p from those of the pairs, r[:, j] = P(a | a or b): least sum over a, b of (r_ba p_a - r_ab p_b)^2 with sum one."""
    whole = np.zeros((len(r), n_classes, n_classes))
    for j, (a, b) in enumerate(pairs):
        whole[:, a, b], whole[:, b, a] = r[:, j], 1 - r[:, j]
    system = np.zeros((len(r), n_classes + 1, n_classes + 1))
    system[:, :n_classes, :n_classes] = -whole * whole.transpose(0, 2, 1)
    classes = np.arange(n_classes)
    system[:, classes, classes] = (whole**2).sum(axis=1)
    system[:, :n_classes, n_classes] = system[:, n_classes, :n_classes] = 1
    end = np.zeros((len(r), n_classes + 1, 1))
    end[:, n_classes] = 1
    p = np.maximum(np.linalg.solve(system, end)[:, :n_classes, 0], 0)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class _Machines:
    """a, b: the classes; c: the weight of losses; outer, inner: the folds left out (-1: none)."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    outer: np.ndarray
    inner: np.ndarray

    def chosen(self, which) -> _Machines:
        return _Machines(self.a[which], self.b[which], self.c[which], self.outer[which], self.inner[which])

    def blocks(self) -> list[slice]:
        """Neighbouring machines of one pair, BLOCK at most: only that pair's rows are multiplied for them."""
        n = len(self.a)
        ends = np.append(np.flatnonzero((np.diff(self.a) != 0) | (np.diff(self.b) != 0)) + 1, n) if n else []
        return [slice(k, min(k + BLOCK, end)) for begin, end in zip([0, *ends[:-1]], ends) for k in range(begin, end, BLOCK)]

    def sides(self, label: np.ndarray, outer: np.ndarray, inner: np.ndarray, which: slice) -> np.ndarray:
        """1 and -1 for the rows of the two classes, 0 for rows that a machine doesn't learn from."""
        a, b = self.a[which], self.b[which]
        seen = (outer[:, None] != self.outer[which]) & (inner[:, None] != self.inner[which])
        return ((label[:, None] == a).astype(float) - (label[:, None] == b)) * seen


def hinge(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded hinge and its slope."""
    short = 1 - m
    bend = np.clip(short, 0, ROUND)
    return bend * bend / (2 * ROUND) + np.maximum(short - ROUND, 0), -bend / ROUND


def _rows(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    x = dense(b.column("x"), width)
    others = [b.column(c).to_numpy() for c in ("label", "weight", "outer", "inner")]
    for k in range(0, len(x), ROWS):
        yield x[k : k + ROWS], *(o[k : k + ROWS] for o in others)


def _losses(rows: DataFrame, machines: _Machines, w: np.ndarray, d: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(machines, steps, 1 + width + 1): loss and gradient of each at w + step * d; the last weight is the bias."""
    width, blocks = w.shape[1] - 1, machines.blocks()

    def work(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        out = {}
        for x, label, weight, outer, inner in _rows(batch, width):
            x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for slot, which in enumerate(blocks):
                here = np.flatnonzero((label == machines.a[which.start]) | (label == machines.b[which.start]))
                if not len(here):
                    continue
                side, own = machines.sides(label[here], outer[here], inner[here], which), x1[here]
                cost = np.abs(side) * weight[here, None] * machines.c[which]
                m, md = own @ w[which].T, own @ d[which].T
                got = np.zeros((which.stop - which.start, len(steps), width + 2))
                for t, step in enumerate(steps):
                    loss, slope = hinge(side * (m + step * md))
                    got[:, t, 0] = (loss * cost).sum(axis=0)
                    got[:, t, 1:] = (slope * side * cost).T @ own
                out[slot] = out.get(slot, 0) + got.ravel()
        return out

    sums = totals(rows, work)
    out = np.concatenate([sums[slot].reshape(-1, len(steps), width + 2) if slot in sums else np.zeros((b.stop - b.start, len(steps), width + 2)) for slot, b in enumerate(blocks)])
    at = w[:, None, :-1] + steps[None, :, None] * d[:, None, :-1]
    out[..., 0] += (at**2).sum(axis=2) / 2
    out[..., 1:-1] += at
    return out


def _directions(grad: np.ndarray, moved: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """L-BFGS's two loops, for all machines at once."""
    q, kept = grad.copy(), []
    for s, y in reversed(moved):
        sy = (s * y).sum(axis=1)
        rho = np.where(sy > 1e-12, 1 / np.maximum(sy, 1e-12), 0)
        alpha = rho * (s * q).sum(axis=1)
        q -= alpha[:, None] * y
        kept.append((rho, alpha))
    if moved:
        s, y = moved[-1]
        yy = (y * y).sum(axis=1)
        q *= np.where(yy > 1e-12, np.maximum((s * y).sum(axis=1), 1e-12) / np.maximum(yy, 1e-12), 1)[:, None]
    else:
        q /= np.maximum(1, np.linalg.norm(q, axis=1))[:, None]
    for (s, y), (rho, alpha) in zip(moved, reversed(kept)):
        beta = rho * (y * q).sum(axis=1)
        q += (alpha - beta)[:, None] * s
    return -q


def _minimised(rows: DataFrame, machines: _Machines, width: int, tol: np.ndarray) -> np.ndarray:
    """Weights of least cost. A pass takes only the machines that still move; where no step lowers a loss, the machine forgets its steps and tries shorter ones down its gradient."""
    w = np.zeros((len(machines.a), width + 1))
    start = _losses(rows, machines, w, np.zeros_like(w), np.zeros(1))[:, 0]
    loss, grad, moved = start[:, 0], start[:, 1:], []
    first, failed = np.maximum(np.linalg.norm(grad, axis=1), 1e-12), np.zeros(len(w), int)
    for _ in range(PASSES):
        on = np.flatnonzero((np.linalg.norm(grad, axis=1) > tol * first) & (failed < FAILURES))
        if not len(on):
            break
        g, at = grad[on], loss[on]
        d = _directions(g, [(s[on], y[on]) for s, y in moved])
        down = ((d * g).sum(axis=1) >= 0) | (failed[on] > 0)
        d[down] = -g[down] / (first[on] * 10.0 ** np.maximum(failed[on] - 1, 0))[down, None]
        tried = _losses(rows, machines.chosen(on), w[on], d, STEPS)
        enough = tried[..., 0] <= at[:, None] + 1e-4 * STEPS * (d * g).sum(axis=1)[:, None]
        pick = np.where(enough.any(axis=1), enough.argmax(axis=1), len(STEPS) - 1)
        go = enough.any(axis=1) | (tried[:, -1, 0] < at)
        new = tried[np.arange(len(on)), pick]
        step, turn = np.zeros_like(w), np.zeros_like(w)
        step[on[go]], turn[on[go]] = STEPS[pick[go], None] * d[go], new[go, 1:] - g[go]
        failed[on] = np.where(go, 0, failed[on] + 1)
        for s, y in moved:
            s[on[~go]] = y[on[~go]] = 0
        moved = [*moved, (step, turn)][-MEMORY:]
        w = w + step
        loss[on[go]], grad[on[go]] = new[go, 0], new[go, 1:]
    return w


def _sigmoids(rows: DataFrame, machines: _Machines, w: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slope, offset) for each group: groups[g, f] is the machine that left out inner fold f; a row's margin is its own fold's."""
    n, width = len(groups), w.shape[1] - 1
    lead = groups[:, 0]
    pair = _Machines(machines.a[lead], machines.b[lead], machines.c[lead], machines.outer[lead], np.full(n, -1))
    whole = slice(0, n)

    def passed(fill) -> np.ndarray:
        def work(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            out = 0
            for x, label, _, outer, inner in _rows(batch, width):
                side = pair.sides(label, outer, inner, whole)
                margin = np.zeros_like(side)
                for f in range(FOLDS):
                    mine = inner == f
                    margin[mine] = x[mine] @ w[groups[:, f], :-1].T + w[groups[:, f], -1]
                out = out + fill(side, margin)
            return {0: out}

        return totals(rows, work).get(0)

    counts = passed(lambda side, _: np.stack([(side > 0).sum(axis=0), (side < 0).sum(axis=0)]).astype(float).ravel())
    if counts is None:
        return np.zeros(n), np.zeros(n)
    up, down = counts.reshape(2, n)
    high, low = (up + 1) / (up + 2), 1 / (down + 2)
    at, lengths = np.stack([np.zeros(n), np.log((down + 1) / (up + 1))]), 0.5 ** np.arange(0, 8)

    def terms(at, d):
        def fill(side, m):
            target, on, out = np.where(side > 0, high, low), side != 0, []
            for t in lengths:
                z = (at[0] + t * d[0]) * m + at[1] + t * d[1]
                p = _sigmoid(-z)
                loss = np.where(on, target * z + np.logaddexp(0, -z), 0)
                g, h = np.where(on, target - p, 0), np.where(on, p * (1 - p), 0)
                out.append([v.sum(axis=0) for v in (loss, g * m, g, h * m * m, h * m, h)])
            return np.array(out).ravel()

        return passed(fill).reshape(len(lengths), 6, n)

    state = terms(at, np.zeros((2, n)))[0]
    for _ in range(30):
        _, g0, g1, h00, h01, h11 = state
        if max(np.abs(g0).max(), np.abs(g1).max()) < 1e-5:
            break
        h00, h11 = h00 + 1e-12, h11 + 1e-12
        det = h00 * h11 - h01 * h01
        d = -np.stack([h11 * g0 - h01 * g1, h00 * g1 - h01 * g0]) / np.where(det > 1e-300, det, np.inf)
        tried = terms(at, d)
        enough = tried[:, 0] <= state[0] + 1e-4 * lengths[:, None] * (d[0] * g0 + d[1] * g1)
        pick = enough.argmax(axis=0)
        go = enough.any(axis=0)
        if not go.any():
            break
        at = at + np.where(go, lengths[pick], 0) * d
        state = np.where(go, tried[pick, :, np.arange(n)].T, state)
    return at[0], at[1]


def fit_all(df: DataFrame, n_classes: int, models: Sequence[tuple[Settings, int | None]], seed: int = 0) -> list[Svc]:
    """A model for each (settings, fold left out or None). df: key, label (0, 1, 2, ...), features, weight, and fold where one is named."""
    width = len(df.select("features").first()[0])
    inner = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(FOLDS)).cast("int")
    outer = F.coalesce(F.col("fold"), F.lit(-2)).cast("int") if "fold" in df.columns else F.lit(-2)
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    rows = df.select("key", F.col("label").cast("int").alias("label"), weight.alias("weight"), outer.alias("outer"), inner.alias("inner"), vector_to_array("features").alias("x"))
    kept = held(rows, df.count())
    rows = kept.drop("key")
    pairs = np.array([(a, b) for a in range(n_classes) for b in range(a + 1, n_classes)])
    each = [(i, j, f) for j in range(len(pairs)) for i in range(len(models)) for f in range(-1, FOLDS)]
    i, j, f = np.array(each).T
    of = lambda v: np.array([v(s, fold) for s, fold in models])[i]
    machines = _Machines(pairs[j, 0], pairs[j, 1], of(lambda s, _: s.c), of(lambda _, fold: -1 if fold is None else fold), f)
    try:
        w = _minimised(rows, machines, width, of(lambda s, _: s.tol))
        whole = np.flatnonzero(f < 0)
        slope, offset = _sigmoids(rows, machines, w, whole[:, None] + 1 + np.arange(FOLDS))
    finally:
        kept.unpersist()
    part = lambda v, k: v[k :: len(models)]
    return [Svc(n_classes, pairs, part(w[whole], k)[:, :-1], part(w[whole], k)[:, -1], part(slope, k), part(offset, k)) for k in range(len(models))]


@dataclass(frozen=True)
class PairwiseSvc:
    """The estimator: fit() learns the number of classes from the labels."""

    settings: Settings = Settings()
    seed: int = 0

    def fit(self, df: DataFrame) -> Svc:
        return fit_all(df, max(2, int(df.agg(F.max("label")).first()[0]) + 1), [(self.settings, None)], self.seed)[0]
