"""Second-order boosted trees with a softmax over the classes, grown level by level over distributed gradient histograms.

Features are cut into bins at their quantiles.  In each level's job every task adds up the
gradients and curvatures of its rows by output, node, feature and bin; Spark sums the
tasks' histograms, and the task that holds a node's whole histogram chooses its best split.
The driver gets one row a node.  A round grows one tree for each class (one in all if there
are two classes, as in logistic loss), all of them in the same jobs; so do several models with
settings of their own, each on its own rows, as a search asks for.

Gradients are rounded to whole 2^-24ths, so their sums don't depend on how rows are dealt
over tasks.  Missing values (null, NaN) go to the side of a split where they do better.
Margins of earlier rounds are written down every CARRIED rounds; in between they are
computed from the trees grown since.

A search has many models to grow for hundreds of rounds.  Where the table's bins fit into
GATHERED_BYTES, they are sent to a task a model, which takes the same sums over all rows itself
(held_out): the same trees, without a job a level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.summed import add_up
from lumenframe.scratch import checkpointed

UNIT = float(1 << 24)
CARRIED = 10
BINS = 64
MISSING = np.uint8(255)
#: Bins of all rows, one byte each, up to which they are sent to a task a model; cells of a histogram and rows that such a task takes at once; rows from which it goes by feature; bytes of histograms that it keeps for the next level.
GATHERED_BYTES, CELLS, AT_ONCE, BY_FEATURE, KEPT_BYTES = 1 << 26, 1 << 18, 1 << 16, 1 << 10, 1 << 26


@dataclass(frozen=True)
class Settings:
    rounds: int = 10
    learning_rate: float = 0.3
    max_depth: int = 6
    gamma: float = 0.0
    min_child_weight: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    max_delta_step: float = 0.0
    scale_pos_weight: float = 1.0
    seed: int = 0


@dataclass
class Tree:
    """Nodes by number: node 0 is the root. cut: the bin up to which a row goes left; feature -1: a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self, n: int) -> int:
        first = len(self.feature)
        for part, empty in ((self.feature, -1), (self.cut, 0), (self.missing_left, True), (self.left, 0), (self.value, 0.0), (self.cover, 0.0), (self.gain, 0.0)):
            part += [empty] * n
        return first

    def prune(self, least: float) -> None:
        """Splits between two leaves that gain less become leaves, from the last to the first."""
        for node in reversed(range(len(self.feature))):
            at = self.left[node]
            if self.feature[node] >= 0 and self.gain[node] < least and self.feature[at] < 0 and self.feature[at + 1] < 0:
                self.feature[node], self.gain[node] = -1, 0.0

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature, cut, missing, left = np.array(self.feature), np.array(self.cut), np.array(self.missing_left), np.array(self.left)
        at = np.zeros(len(bins), np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            here = at[inner]
            b = bins[inner, feature[here]]
            goes_left = np.where(b == MISSING, missing[here], b <= cut[here])
            at[inner] = left[here] + ~goes_left
        return at

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value: the number of cuts below it."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(c, x[:, f], "left"))
    return out


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; nulls are NaN."""
    flat = column.flatten()
    if len(flat) == len(column) * width:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
    return np.array([[np.nan if v is None else v for v in r] for r in column.to_pylist()], float).reshape(len(column), width)


@dataclass
class Booster:
    """trees: those of a round by output, round after round."""

    settings: Settings
    n_classes: int
    cuts: list[np.ndarray]
    trees: list[list[Tree]] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return 1 if self.n_classes == 2 else self.n_classes

    def margins(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.outputs))
        for trees in self.trees[since:]:
            for k, t in enumerate(trees):
                out[:, k] += t(bins)
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        if self.outputs == 1:
            p = 1 / (1 + np.exp(-margins))
            return np.concatenate([1 - p, p], axis=1)
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with rawPrediction (margins), probability and prediction; classes are 0, 1, 2, ..."""
        model, width = self, len(self.cuts)

        @F.pandas_udf("array<double>")
        def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                x = np.array([[np.nan if v is None else v for v in r] for r in s], float).reshape(len(s), width)
                yield pd.Series(list(model.margins(binned(x, model.cuts))))

        raw = df.withColumn("rawPrediction", margins(vector_to_array("features")))
        if self.outputs == 1:
            p1 = 1 / (1 + F.exp(-F.get("rawPrediction", F.lit(0))))
            p = F.array(1 - p1, p1)
        else:
            e = F.transform(F.array(F.array_max("rawPrediction")), lambda top: F.transform("rawPrediction", lambda v: F.exp(v - top)))
            p = F.get(F.transform(e, lambda b: F.transform(F.array(F.aggregate(b, F.lit(0.0), lambda a, v: a + v)), lambda s: F.transform(b, lambda v: v / s))), F.lit(0))
            p = F.get(p, F.lit(0))
        out = raw.withColumn("__p", p)
        said = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        return out.withColumn("prediction", said).withColumns({"rawPrediction": array_to_vector("rawPrediction"), "probability": array_to_vector("__p")}).drop("__p")

    @property
    def importances(self) -> np.ndarray:
        """Gain by feature, as shares."""
        out = np.zeros(len(self.cuts))
        for trees in self.trees:
            for t in trees:
                for f, g in zip(t.feature, t.gain):
                    if f >= 0:
                        out[f] += g
        return out / max(out.sum(), 1e-300)


def quantile_cuts(df: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Up to bins - 1 cuts for each feature; the greatest value is none."""
    x = df.select(vector_to_array("features").alias("x"))
    wide = x.select(*(F.when(~F.isnan(F.get("x", F.lit(f))), F.get("x", F.lit(f))).alias(f"f{f}") for f in range(width)))
    found = wide.approxQuantile(wide.columns, [k / bins for k in range(1, bins)] + [1.0], 0.25 / bins)
    return [np.array(sorted({v for v in own if v < own[-1]})) if own else np.array([]) for own in found]


def _draws(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) from a key and a seed, by 64-bit mixing: the same in whatever task."""
    z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def gradients(margins: np.ndarray, label: np.ndarray, n_classes: int, scale_pos: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Of softmax loss by output (curvature 2p(1 - p)), or of logistic loss for two classes."""
    if n_classes == 2:
        p, w = 1 / (1 + np.exp(-margins)), np.where(label == 1, scale_pos, 1.0)[:, None]
        return (p - label[:, None]) * w, np.maximum(p * (1 - p), 1e-16) * w
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - np.eye(n_classes)[label], np.maximum(2 * p * (1 - p), 1e-16)


def leaf_value(g, h, s: Settings):
    """The step of least loss, with both penalties and the bound of a step."""
    v = -np.sign(g) * np.maximum(np.abs(g) - s.reg_alpha, 0) / (h + s.reg_lambda)
    return np.clip(v, -s.max_delta_step, s.max_delta_step) if s.max_delta_step else v


def _score(g, h, s: Settings):
    if not s.reg_alpha and not s.max_delta_step:
        gain = g * g
        gain /= h + s.reg_lambda
        return gain
    v = leaf_value(g, h, s)
    return -(2 * g * v + (h + s.reg_lambda) * v * v + 2 * s.reg_alpha * np.abs(v))


def best_splits(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """gain, feature (-1: none), cut, missing_left, and G and H left, G and H right (nodes, 4) of each node, from sums (nodes, features, bins); the last bin is that of missing values.

    Of equal gains the first feature's lowest cut, with missing values to the left, is taken.
    """
    whole_g, whole_h = (v[:, 0].sum(axis=1) for v in (g, h))
    known_g, known_h = (np.cumsum(v[:, :, :-2], axis=2) for v in (g, h))
    missing_g, missing_h = g[:, :, -1:], h[:, :, -1:]
    sides = [(known_g + missing_g, known_h + missing_h), (known_g, known_h)] if missing_h.any() or missing_g.any() else [(known_g, known_h)]  # nothing is missing: both are the same
    gains = []
    for left_g, left_h in sides:
        right_g, right_h = whole_g[:, None, None] - left_g, whole_h[:, None, None] - left_h
        gain = _score(left_g, left_h, s)
        gain += _score(right_g, right_h, s)
        np.copyto(gain, -np.inf, where=(left_h < s.min_child_weight) | (right_h < s.min_child_weight))
        if not allowed.all():
            gain[~allowed] = -np.inf
        gains.append(gain)
    both = np.stack(gains, axis=3) if len(gains) > 1 else gains[0][..., None]  # node, feature, cut, side of the missing
    flat, nodes = both.reshape(len(g), -1), np.arange(len(g))
    if not flat.shape[1]:
        return np.zeros(len(g)), np.full(len(g), -1), np.zeros(len(g), int), np.ones(len(g), bool), np.zeros((len(g), 4))
    at = flat.argmax(axis=1)
    f, cut, side = np.unravel_index(at, both.shape[1:])
    left = np.stack([v[nodes, f, cut] + np.where(side == 0, m[nodes, f, 0], 0) for v, m in ((known_g, missing_g), (known_h, missing_h))], axis=1)
    sums = np.concatenate([left, np.stack([whole_g, whole_h], axis=1) - left], axis=1)
    gain = flat[nodes, at] - _score(whole_g, whole_h, s)
    good = gain > 1e-9
    return np.where(good, gain, 0.0), np.where(good, f, -1), np.where(good, cut, 0), (side == 0) | ~good, np.where(good[:, None], sums, 0.0)


def best_split(hist: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[float, int, int, bool, np.ndarray]:
    """best_splits of one node, from (features, bins, 2)."""
    gain, f, cut, missing_left, sums = best_splits(hist[None, ..., 0], hist[None, ..., 1], allowed[None], s)
    return float(gain[0]), int(f[0]), int(cut[0]), bool(missing_left[0]), sums[0]


def _sampled(rng: np.random.Generator, allowed: np.ndarray, share: float) -> np.ndarray:
    """So many of the allowed features, one at least."""
    if share >= 1:
        return allowed
    own, out = np.flatnonzero(allowed), np.zeros(len(allowed), bool)
    out[rng.permutation(own)[: max(1, int(share * len(own)))]] = True
    return out


@dataclass
class _Growing:
    """One model in the making: rows says which rows of the table are its own, given their fold."""

    booster: Booster
    fold: int | None
    carried: int = 0
    open: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # (output, node) -> features allowed


def fit_all(df: DataFrame, n_classes: int, models: Sequence[tuple[Settings, int | None]], bins: int = BINS, cuts: Sequence[np.ndarray] | None = None) -> list[Booster]:
    """A booster for each (settings, fold left out or None), all grown in the same jobs.

    df: key, label (0, 1, 2, ...), features, and fold where one is named. Without cuts, they are
    approximate quantiles, which may differ a little with the partitions.
    """
    if not 2 <= bins <= 254:
        raise ValueError("bins must be from 2 to 254")
    width = len(df.select("features").first()[0])
    cuts = list(cuts) if cuts is not None else quantile_cuts(df, width, bins)
    outputs = 1 if n_classes == 2 else n_classes

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = binned(dense(b.column("x"), width), cuts)
            start = np.zeros((b.num_rows, len(models) * outputs))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in start], pa.binary())], names=["key", "label", "fold", "bins", "margins"])

    kind = "key long, label int, fold int, bins binary, margins binary"
    held = _plain(df).mapInArrow(prepare, kind).persist()
    growing = [_Growing(Booster(s, n_classes, cuts), fold) for s, fold in models]
    try:
        for r in range(max(s.rounds for s, _ in models)):
            now = [m for m in growing if r < m.booster.settings.rounds]
            _grow_round(lambda *level: _level(held, growing, *level, width, bins), growing, now, r, width)  # noqa: B023
            if (r + 1) % CARRIED == 0 and r + 1 < max(s.rounds for s, _ in models):
                held = _carry(held, growing, kind)
    finally:
        held.unpersist()
    return [m.booster for m in growing]


def _plain(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("key", F.lit(0)).cast("long").alias("key"), F.col("label").cast("int").alias("label"), (F.col("fold") if "fold" in df.columns else F.lit(-1)).cast("int").alias("fold"), vector_to_array("features").alias("x"))


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _carry(held: DataFrame, growing: list[_Growing], kind: str) -> DataFrame:
    """The table with the margins of all trees so far, written down so that its lineage ends."""
    since = [(m.booster, m.carried) for m in growing]
    outputs, width = growing[0].booster.outputs, len(growing[0].booster.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, margins = _matrix(b.column("bins"), np.uint8, width), _matrix(b.column("margins"), np.float64, len(since) * outputs).copy()
            for i, (model, at) in enumerate(since):
                margins[:, i * outputs : (i + 1) * outputs] += model.margins(x, at)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in margins], pa.binary())], names=b.schema.names)

    out = checkpointed(held.mapInArrow(run, kind)).persist()
    held.unpersist()
    for m in growing:
        m.carried = len(m.booster.trees)
    return out


def _grow_round(level_of: Callable[..., dict[int, tuple]], growing: list[_Growing], now: list[_Growing], r: int, width: int) -> None:
    """One more tree for each output of each model, level by level. level_of(trees, slots, masks, round) says what becomes of each open node."""
    outputs = growing[0].booster.outputs
    new = [[Tree() for _ in range(outputs)] for _ in growing]
    rngs = {id(m): np.random.default_rng([m.booster.settings.seed, r]) for m in now}
    by_tree = {}
    for m in now:
        s, rng = m.booster.settings, rngs[id(m)]
        by_tree[id(m)] = [_sampled(rng, np.ones(width, bool), s.colsample_bytree) for _ in range(outputs)]
        m.open = {(k, 0): None for k in range(outputs)}
    for depth in range(max(m.booster.settings.max_depth for m in now) + 1):
        slots: list[tuple[int, int, int]] = []
        masks: list[np.ndarray] = []
        for i, m in enumerate(growing):
            if m not in now:
                continue
            s, rng = m.booster.settings, rngs[id(m)]
            level = [_sampled(rng, mask, s.colsample_bylevel) for mask in by_tree[id(m)]]
            for k, node in m.open:
                slots.append((i, k, node))
                masks.append(_sampled(rng, level[k], s.colsample_bynode) if depth < s.max_depth else np.zeros(width, bool))
        if not slots:
            break
        found = level_of(new, slots, masks, r)
        values = {}
        for i in {i for i, _, _ in slots}:  # of each node and its two sides
            own = [slot for slot, (j, _, _) in enumerate(slots) if j == i and slot in found]
            sums = np.array([found[slot][4:10] for slot in own]).reshape(-1, 3, 2)
            s = growing[i].booster.settings
            values |= dict(zip(own, (leaf_value(sums[..., 0], sums[..., 1], s) * s.learning_rate).tolist()))
        for m in now:
            m.open = {}
        for slot, (i, k, node) in enumerate(slots):
            if slot not in found:
                continue
            m, tree, (gain, f, cut, missing_left, _, h, _, hl, _, hr) = growing[i], new[i][k], found[slot]
            s = m.booster.settings
            tree.cover[node], tree.value[node] = h, values[slot][0]
            if f >= 0:
                at = tree.add(2)
                tree.feature[node], tree.cut[node], tree.missing_left[node], tree.left[node], tree.gain[node] = f, cut, missing_left, at, gain
                for child, ch, value in ((at, hl, values[slot][1]), (at + 1, hr, values[slot][2])):
                    tree.cover[child], tree.value[child] = ch, value
                    if depth + 1 < s.max_depth and ch >= 2 * s.min_child_weight:  # with less no split can leave enough on both sides
                        m.open[k, child] = None
    for i, m in enumerate(growing):
        if m in now:
            for tree in new[i]:
                tree.prune(m.booster.settings.gamma)
            m.booster.trees.append(new[i])


def _level(held, growing, new, slots, masks, r, width, bins) -> dict[int, tuple]:
    """What becomes of each open node: its sums and its best split, by slot."""
    outputs = growing[0].booster.outputs
    parts = [(replace(m.booster, trees=m.booster.trees[m.carried :]), m.fold) for m in growing]
    wanted: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for slot, (i, k, node) in enumerate(slots):
        wanted.setdefault(i, {}).setdefault(k, []).append((node, slot))
    settings = [growing[i].booster.settings for i, _, _ in slots]
    offsets = np.arange(width, dtype=np.int64) * (bins + 1)

    def work(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        x, carried = _matrix(b.column("bins"), np.uint8, width), _matrix(b.column("margins"), np.float64, len(parts) * outputs)
        keys, label, folds = (b.column(c).to_numpy() for c in ("key", "label", "fold"))
        place = np.where(x == MISSING, bins, x) + offsets  # the last bin of a feature holds its missing values
        out = {}
        for i, by_output in wanted.items():
            model, fold = parts[i]
            s = model.settings
            own = np.ones(len(x), bool) if fold is None else folds != fold
            if s.subsample < 1:
                own &= _draws(keys, s.seed * 1_000_003 + r) < s.subsample
            rows = np.flatnonzero(own)
            if not len(rows):
                continue
            margins = carried[rows, i * outputs : (i + 1) * outputs] + model.margins(x[rows])
            g, h = (np.rint(v * UNIT) for v in gradients(margins, label[rows], model.n_classes, s.scale_pos_weight))
            for k, nodes in by_output.items():
                at = new[i][k].nodes(x[rows])
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], [[node, node + 1] for node, _ in nodes])
                for (begin, end), (_, slot) in zip(ends, nodes, strict=True):
                    here = order[begin:end]
                    if len(here):
                        cell = place[rows[here]].ravel()
                        both = [np.bincount(cell, np.repeat(v[here, k], width), width * (bins + 1)) for v in (g, h)]
                        out[slot] = np.rint(np.stack(both, axis=1)).astype(np.int64).ravel()
        return out

    def finish(slot: int, total: np.ndarray) -> pa.Table:
        hist = total.reshape(width, bins + 1, 2) / UNIT
        g, h = hist[0].sum(axis=0)
        gain, f, cut, missing_left, sides = best_split(hist, masks[slot], settings[slot])
        values = [slot, gain, f, cut, missing_left, g, h, *sides]
        return pa.table({c: pa.array([v], t) for c, v, t in zip(_FOUND, values, (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.float64()] * 6))})

    rows = add_up(held, work, finish, ", ".join(f"{c} {t}" for c, t in _FOUND.items())).collect()
    return {row["slot"]: tuple(row)[1:] for row in rows}


#: A node's row; the driver gets one for each.
_FOUND = {"slot": "long", "gain": "double", "feature": "long", "cut": "long", "missing_left": "boolean", "g": "double", "h": "double", "gl": "double", "hl": "double", "gr": "double", "hr": "double"}


class _Gathered:
    """All rows in one task, for one model: their margins, and the node of each in the trees of a round.

    x: bins, where missing values have the bin after the last. own: the rows to learn from; the others only go along.
    """

    def __init__(self, x: np.ndarray, keys: np.ndarray, label: np.ndarray, own: np.ndarray, model: Booster, bins: int):
        self.x, self.keys, self.label, self.own, self.model, self.bins = x, keys, label, own, model, bins
        self.by_feature = np.ascontiguousarray(x.T)
        self.carried, self.since = (np.zeros((len(x), model.outputs)) for _ in range(2))  # added up as _carry does

    def grow(self, r: int) -> None:
        s = self.model.settings
        own = self.own if s.subsample >= 1 else self.own & (_draws(self.keys, s.seed * 1_000_003 + r) < s.subsample)
        self.rows = np.flatnonzero(own)
        both = gradients(self.carried[self.rows] + self.since[self.rows], self.label[self.rows], self.model.n_classes, s.scale_pos_weight)
        self.g, self.h = (np.ascontiguousarray(np.rint(v * UNIT).T) for v in both)
        self.at = np.zeros((self.model.outputs, len(self.x)), np.int32)
        self.kept: dict[tuple[int, int], tuple] = {}  # (output, node) -> its histograms over all features
        _grow_round(self.level, [growing := _Growing(self.model, None)], [growing], r, self.x.shape[1])
        for k, tree in enumerate(self.model.trees.pop()):
            while self.descend(k, tree):
                pass
            stands = np.arange(len(tree.feature))  # a pruned node stands for all that were below it
            for node, left in enumerate(tree.left):
                if left and tree.feature[node] < 0:
                    stands[left : left + 2] = stands[node]
            self.since[:, k] += np.array(tree.value)[stands[self.at[k]]]
        if (r + 1) % CARRIED == 0:
            self.carried += self.since
            self.since[:] = 0

    def descend(self, k: int, tree: Tree) -> int:
        """Rows go one node down where theirs is split; their number."""
        at, feature = self.at[k], np.array(tree.feature)
        inner = np.flatnonzero(feature[at] >= 0)
        here = at[inner]
        b = self.x[inner, feature[here]]
        goes_left = np.where(b == self.bins, np.array(tree.missing_left)[here], b <= np.array(tree.cut)[here])
        at[inner] = np.array(tree.left)[here] + ~goes_left
        return len(inner)

    def level(self, new: list[list[Tree]], slots: list[tuple[int, int, int]], masks: list[np.ndarray], r: int) -> dict[int, tuple]:
        """What becomes of each open node, as _level has it."""
        out: dict[int, tuple] = {}
        by_output: dict[int, list[tuple[int, int]]] = {}
        for slot, (_, k, node) in enumerate(slots):
            by_output.setdefault(k, []).append((node, slot))
        before, self.kept = self.kept, {}
        for k, nodes in by_output.items():
            tree = new[0][k]
            self.descend(k, tree)
            place = np.full(len(tree.feature), -1, np.int32)
            place[[node for node, _ in nodes]] = np.arange(len(nodes))
            at = place[self.at[k, self.rows]]
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(nodes) + 1))
            full = [j for j in range(len(nodes)) if ends[j] < ends[j + 1]]
            allowed = np.array([masks[slot] for _, slot in nodes])
            columns = np.flatnonzero(allowed.any(axis=0))
            if not len(columns):  # a last level: no more splits
                sums = [np.bincount(at[order[ends[0] :]], v[k][order[ends[0] :]], len(nodes)) / UNIT for v in (self.g, self.h)]
                out |= {nodes[j][1]: (0.0, -1, 0, True, float(sums[0][j]), float(sums[1][j]), 0.0, 0.0, 0.0, 0.0) for j in full}
                continue
            step = max(1, CELLS // (len(columns) * (self.bins + 1)))
            for begin in range(0, len(full), step):
                part = full[begin : begin + step]
                g, h = self.histograms(k, tree, [nodes[j][0] for j in part], [order[ends[j] : ends[j + 1]] for j in part], columns, before)
                gain, f, cut, missing_left, sides = best_splits(g, h, allowed[np.ix_(part, columns)], self.model.settings)
                f = np.where(f >= 0, columns[f], -1)
                whole = zip(g[:, 0].sum(axis=1).tolist(), h[:, 0].sum(axis=1).tolist())
                for j, *row, w, side in zip(part, gain.tolist(), f.tolist(), cut.tolist(), missing_left.tolist(), whole, sides.tolist()):
                    out[nodes[j][1]] = (*row, *w, *side)
        return out

    def histograms(self, k: int, tree: Tree, nodes: list[int], rows: list[np.ndarray], columns: np.ndarray, before: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """Sums of gradients and curvatures (2, nodes, columns, bins); over all features the larger of two siblings is its parent without the other, all sums being exact."""
        if len(columns) < self.x.shape[1]:
            return self.summed(k, rows, columns)
        parent = {child: node for node, left in enumerate(tree.left) if left for child in (left, left + 1)}
        rest = {}  # the larger sibling's place -> the smaller one's
        for j in range(len(nodes) - 1):
            if nodes[j] and parent[nodes[j]] == parent.get(nodes[j + 1]) and (k, parent[nodes[j]]) in before:
                large = j + (len(rows[j]) < len(rows[j + 1]))
                rest[large] = 2 * j + 1 - large
        direct = [j for j in range(len(nodes)) if j not in rest]
        out = np.empty((2, len(nodes), len(columns), self.bins + 1))
        out[:, direct] = self.summed(k, [rows[j] for j in direct], columns)
        for large, small in rest.items():
            np.subtract(before[k, parent[nodes[large]]], out[:, small], out=out[:, large])
        if (len(self.kept) + len(nodes)) * out[:, 0].nbytes <= KEPT_BYTES:
            self.kept |= {(k, node): out[:, j] for j, node in enumerate(nodes)}
        return out

    def summed(self, k: int, rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        wide, size, at = len(columns), self.bins + 1, np.concatenate(rows)
        node, out = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.zeros((2, len(rows), wide, size))
        for begin in range(0, len(at), AT_ONCE):
            some, own = at[begin : begin + AT_ONCE], node[begin : begin + AT_ONCE]
            sums, here = (self.g[k, some], self.h[k, some]), self.rows[some]
            if len(some) > BY_FEATURE:
                base = own * size
                for i, f in enumerate(columns):
                    cell = base + self.by_feature[f][here]
                    for v, total in zip(sums, out):
                        total[:, i] += np.bincount(cell, v, len(rows) * size).reshape(-1, size)
            else:
                x = self.x[here]
                cell = ((x if wide == x.shape[1] else x[:, columns]) + (own[:, None] * (wide * size) + np.arange(wide) * size)).ravel()
                for v, total in zip(sums, out):
                    total += np.bincount(cell, np.repeat(v, wide), total.size).reshape(total.shape)
        return out / UNIT


def gathered(df: DataFrame, cuts: Sequence[np.ndarray], rows: int, bins: int = BINS) -> Broadcast | None:
    """keys, labels, folds and bins of all rows, for held_out; none where the bins are over GATHERED_BYTES."""
    width = len(cuts)
    if rows * width > GATHERED_BYTES:
        return None

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = binned(dense(b.column("x"), width), cuts)
            x[x == MISSING] = bins
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "label", "fold", "bins"])

    got = _plain(df).mapInArrow(prepare, "key long, label int, fold int, bins binary").toArrow()
    x = np.concatenate([_matrix(c, np.uint8, width) for c in got["bins"].chunks] or [np.zeros((0, width), np.uint8)])
    return df.sparkSession.sparkContext.broadcast((*(got[c].to_numpy() for c in ("key", "label", "fold")), x))


def held_out(spark: SparkSession, table: Broadcast, n_classes: int, models: Sequence[tuple[Settings, int]], bins: int = BINS) -> DataFrame:
    """model, label, probability (array) of the rows of each model's fold, by what the other folds teach: the trees of fit_all, each model in a task of its own."""
    longest = sorted(range(len(models)), key=lambda i: -models[i][0].rounds)  # they start first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for turn in b.column("id").to_pylist():
                i = longest[turn]
                (settings, fold), (keys, label, folds, x) = models[i], table.value
                model = Booster(settings, n_classes, [])
                work = _Gathered(x, keys, label, folds != fold, model, bins)
                for r in range(settings.rounds):
                    work.grow(r)
                test = np.flatnonzero(folds == fold)
                for at in np.array_split(test, -(-len(test) // 4096)) if len(test) else []:
                    p = model.probabilities(work.carried[at] + work.since[at])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(label[at].astype(float)), pa.array(list(p), pa.list_(pa.float64()))], names=["model", "label", "probability"])

    return spark.range(0, len(models), 1, len(models)).mapInArrow(run, "model int, label double, probability array<double>")


@dataclass(frozen=True)
class SoftmaxBoosting:
    """The estimator: fit() learns the number of classes from the labels."""

    settings: Settings = Settings()
    bins: int = BINS

    def fit(self, df: DataFrame) -> Booster:
        n_classes = int(df.agg(F.max("label")).first()[0]) + 1
        return fit_all(df, max(2, n_classes), [(self.settings, None)], self.bins)[0]
