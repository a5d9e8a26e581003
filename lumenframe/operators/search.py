"""Adaptive search of classifier settings: one Parzen density a setting proposes, rungs of folds promote the best share.

Trials come in generations, the first of START.  Those of a generation are proposed from the trials before it and
run side by side: SVC fits all of them in the same passes over the rows, boosted trees in a
task each (tables over boosting.GATHERED_BYTES: in the same passes), the other classifiers as
concurrent Spark jobs.  After each fold a trial goes on only if its mean is
among the best 1 / SHARE of all trials that got as far (the best one always does).  Decisions
are made between generations and folds, in the order of the trials, so they don't depend on
which job ends first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import boosting, learning, statistics, svc
from lumenframe.operators.relational import hash_numbered
from lumenframe.operators.summed import held

#: Trials of a generation; trials before the densities are used; share that a rung promotes; draws from a density; share that counts as good.
GENERATION, START, SHARE, DRAWS, GOOD = 5, 10, 4, 24, 0.2


@dataclass(frozen=True)
class Axis:
    """A setting between two ends, on a line or by powers; whole: whole numbers only. only: the (setting, option) that it belongs to."""

    low: float
    high: float
    powers: bool = False
    whole: bool = False
    only: tuple[str, str] | None = None

    def at(self, u: float):
        v = self.low * (self.high / self.low) ** u if self.powers else self.low + u * (self.high - self.low)
        return int(round(v)) if self.whole else float(v)


@dataclass(frozen=True)
class Choice:
    """A setting that is one of some options; a place u of [0, 1) stands for one of them."""

    options: tuple
    only: tuple[str, str] | None = None

    def at(self, u: float):
        return self.options[min(int(u * len(self.options)), len(self.options) - 1)]


Space = dict[str, Axis | Choice]

#: Settings that are searched, by classifier and step: those of a later step take the best of the earlier ones as given.
SPACES: dict[str, tuple[Space, ...]] = {
    "LDA": ({"solver": Choice(("svd", "eigen")), "shrinkage": Axis(0.0, 1.0, only=("solver", "eigen"))},),
    "Logistic regression": ({"penalty": Choice(("l1", "l2", "elasticnet")), "c": Axis(1e-3, 1e3, powers=True), "l1_ratio": Axis(0.0, 1.0, only=("penalty", "elasticnet"))},),
    "SVC": ({"c": Axis(1e-5, 1e4, powers=True), "tol": Axis(1e-4, 1e-2, powers=True)},),
    "Decision Tree": ({"impurity": Choice(("gini", "entropy")), "maxDepth": Axis(1, 9, whole=True), "minInstancesPerNode": Axis(1, 11, whole=True), "featureSubsetStrategy": Choice(("sqrt", "log2"))},),
    "Random Forest": (
        {"impurity": Choice(("gini", "entropy")), "maxDepth": Axis(1, 10, whole=True), "subsamplingRate": Axis(0.1, 1.0), "minInstancesPerNode": Axis(1, 11, whole=True), "featureSubsetStrategy": Choice(("sqrt", "log2"))},
    ),
    "XGBoost": (
        {"rounds": Axis(50, 500, whole=True), "learning_rate": Axis(0.005, 0.05)},
        {
            "max_depth": Axis(6, 16, whole=True), "gamma": Axis(0, 15, whole=True), "min_child_weight": Axis(4, 16, whole=True), "reg_alpha": Axis(1e-3, 1e4, powers=True), "reg_lambda": Axis(1e-2, 1e2, powers=True),
            "subsample": Axis(0.2, 1.0), "colsample_bytree": Axis(0.2, 1.0), "colsample_bylevel": Axis(0.1, 1.0), "colsample_bynode": Axis(0.1, 1.0), "max_delta_step": Axis(0.0, 10.0),
        },
    ),
}


@dataclass
class Trial:
    """place: a number in [0, 1) for each setting that it has."""

    place: dict[str, float]
    params: dict
    scores: list[float] = field(default_factory=list)
    pruned: bool = False

    @property
    def metric(self) -> float:
        return float(np.mean(self.scores))


def _widths(places: np.ndarray) -> np.ndarray:
    """A bell's width at each place: the larger gap to its neighbours or the ends, so that bells narrow where places gather."""
    order = np.argsort(places, kind="stable")
    gaps = np.diff(np.concatenate([[0.0], places[order], [1.0]]))
    out = np.empty(len(places))
    out[order] = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / min(100, 1 + len(places)), 1.0)
    return out


def _density(at: np.ndarray, places: np.ndarray, options: int) -> np.ndarray:
    """Of places on a setting's axis: bells around the trials' places and one flat share; counts for options."""
    if options:
        counts = np.bincount(np.minimum((places * options).astype(int), options - 1), minlength=options) + 1.0
        return (counts / counts.sum())[np.minimum((at * options).astype(int), options - 1)]
    width = _widths(places)
    bells = np.exp(-((at[:, None] - places[None]) ** 2) / 2 / width**2) / width / np.sqrt(2 * np.pi)
    return (bells.sum(axis=1) + 1) / (len(places) + 1)


def _drawn(places: np.ndarray, options: int, rng: np.random.Generator) -> np.ndarray:
    """Draws around the places, some of them anywhere."""
    anywhere = rng.random(DRAWS)
    if not len(places):
        return anywhere
    which = rng.integers(0, len(places), DRAWS)
    near = places[which]
    if not options:
        near = np.abs(near + rng.normal(0, 1, DRAWS) * _widths(places)[which])  # mirrored at the ends, so that they gather no draws
        near = np.clip(np.where(near > 1, 2 - near, near), 0, 1 - 1e-9)
    return np.where(rng.random(DRAWS) < 1 / (len(places) + 1), anywhere, near)


def propose(done: Sequence[Trial], space: Space, rng: np.random.Generator) -> dict[str, float]:
    """A place for each setting: anywhere at first; then, setting by setting, the draw around the good trials that is likeliest under them against the rest.

    Trials that got further are better than those that were stopped before.  A setting that
    belongs to an option is proposed only with it, and from the trials that had it.
    """
    ranked = sorted(done, key=lambda t: (-len(t.scores), -t.metric))
    cut = max(1, int(np.ceil(GOOD * len(ranked))))
    place: dict[str, float] = {}
    for name, axis in space.items():
        if axis.only and space[axis.only[0]].at(place[axis.only[0]]) != axis.only[1]:
            continue
        if len(done) < START:
            place[name] = float(rng.random())
            continue
        options = len(axis.options) if isinstance(axis, Choice) else 0
        good, rest = (np.array([t.place[name] for t in part if name in t.place]) for part in (ranked[:cut], ranked[cut:]))
        tried = _drawn(good, options, rng)
        place[name] = float(tried[(_density(tried, good, options) / _density(tried, rest, options)).argmax()])
    return place


def promoted(own: float, rung: Sequence[float], share: int = SHARE) -> bool:
    """Whether a value is among the best 1 / share of a rung's values, which hold it; the best one always is."""
    kept = max(1, len(rung) // share)
    return own >= sorted(rung, reverse=True)[kept - 1]


def run_trials(space: Space, score: Callable[[list[dict], int], list[float]], trials: int, folds: int, seed: int, generation: int = GENERATION) -> list[Trial]:
    """score(settings of some trials, fold) gives a value for each."""
    rng, done, rungs = np.random.default_rng(seed), [], [[] for _ in range(folds)]
    while len(done) < trials:
        born = []
        for _ in range(min(generation if done else max(START, generation), trials - len(done))):
            place = propose(done, space, rng)
            born.append(Trial(place, {k: space[k].at(u) for k, u in place.items()}))
        alive = born
        for fold in range(folds):
            for trial, value in zip(alive, score([t.params for t in alive], fold), strict=True):
                trial.scores.append(value)
                rungs[fold].append(trial.metric)
            if fold < folds - 1:
                for trial in alive:
                    trial.pruned = not promoted(trial.metric, rungs[fold])
                alive = [t for t in alive if not t.pruned]
                if not alive:
                    break
        done += born
    return done


def micro_auc(scored: DataFrame) -> dict[int, float]:
    """By trial, the area under the curve of all (row, class) cells together: does a cell's probability tell whether it is the row's class?

    scored: trial, label, probability (array); the k-th probability is of the k-th label.
    """
    cells = scored.select("trial", "label", F.posexplode("probability").alias("class", "p")).persist()  # the ranks read them three times, and each time would score anew
    try:
        return {r["trial"]: r["auc"] for r in statistics.roc_auc(cells, F.col("label") == F.col("class"), "p", "trial").collect()}
    finally:
        cells.unpersist()


def _own_probabilities(test: DataFrame, models: Sequence[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """trial, label, probability: all models in one pass over the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["x"].to_list(), float)
                for i, model in enumerate(models):
                    yield pd.DataFrame({"trial": i, "label": b["label"], "probability": list(model(x))})

    return test.select("label", vector_to_array("features").alias("x")).mapInPandas(run, "trial int, label double, probability array<double>")


def _spark_settings(name: str, params: dict, rows: int) -> dict:
    """A trial's settings as those of the estimator. Penalties of logistic regression weigh against the sum of losses, Spark's against their mean."""
    if name == "Logistic regression":
        return {"regParam": 1 / (params["c"] * max(1, rows)), "elasticNetParam": {"l1": 1.0, "l2": 0.0}.get(params["penalty"], params.get("l1_ratio"))}
    return params


def _fitted(name: str, train: DataFrame, params: dict, rows: int, seed: int):
    if name == "Decision Tree":  # a forest of one tree on all rows: only forests choose among features at each node
        return learning.estimator("Random Forest", seed, numTrees=1, bootstrap=False, **params).fit(train)
    return learning.estimator(name, seed, **_spark_settings(name, params, rows)).fit(train)


def _scores(name: str, dealt: DataFrame, n_classes: int, rows: int, seed: int, given: dict) -> Callable[[list[dict], int], list[float]]:
    cuts: list = []  # of boosted trees: found once for all fits of a step, as is
    gathered: list = []  # the table of their bins

    def score(settings: list[dict], fold: int) -> list[float]:
        train, test = dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
        settings = [given | s for s in settings]
        with ThreadPoolExecutor(len(settings)) as pool:
            if name == "SVC":
                machines = svc.fit_all(dealt, n_classes, [(svc.Settings(**s), fold) for s in settings], seed)
                scored = _own_probabilities(test, [lambda x, m=m: m.probabilities(m.margins(x)) for m in machines])
            elif name == "XGBoost":
                if not cuts:
                    cuts.extend(boosting.quantile_cuts(dealt, len(dealt.select("features").first()[0]), boosting.BINS))
                    gathered.append(boosting.gathered(dealt, cuts, rows))
                models = [(boosting.Settings(seed=seed, **s), fold) for s in settings]
                if gathered[0]:
                    scored = boosting.held_out(dealt.sparkSession, gathered[0], n_classes, models).withColumnRenamed("model", "trial")
                else:
                    boosters = boosting.fit_all(dealt, n_classes, models, cuts=cuts)
                    scored = _own_probabilities(test, [lambda x, m=m: m.probabilities(m.margins(boosting.binned(x, m.cuts))) for m in boosters])
            elif name == "LDA":
                lines = list(pool.map(lambda s: learning.discriminant(train, s.get("shrinkage", 0.0) or 1e-9), settings))
                scored = _own_probabilities(test, [m.probabilities for m in lines])
            else:
                fitted = list(pool.map(lambda s: _fitted(name, train, s, rows, seed), settings))
                each = [m.transform(test).select(F.lit(i).alias("trial"), "label", vector_to_array("probability").alias("probability")) for i, m in enumerate(fitted)]
                scored = reduce(DataFrame.unionByName, each)
        areas = micro_auc(scored)
        return [float(areas.get(i) or 0.5) for i in range(len(settings))]

    return score


#: Trials of the first step, where they are not 20: machines take a job for each step of their descent.
TRIALS = {"Logistic regression": 10, "SVC": 10}


def adaptive(spark: SparkSession, df: DataFrame, name: str, trials: int | None = None, folds: int = 3, seed: int = 0, spaces: Sequence[Space] | None = None) -> DataFrame:
    """step, trial, params (JSON, with those that earlier steps found), folds, metric (area under the curve over all classes), pruned, is_best.

    As many rows as trials (20, or as TRIALS says) in each step; a second step has twice as many.  Folds are of equal share in
    each class. Labels must be 0, 1, 2, ... (relational.encoded gives such).
    """
    spaces, trials = spaces or SPACES[name], trials or TRIALS.get(name, 20)
    whole = df.agg(F.count("*").alias("n"), F.max("label").alias("last")).first()
    dealt = held(hash_numbered(df, "key", seed, ["label"]).withColumn("fold", (F.col("hash_no") % folds).cast("int")).drop("hash_no", "hash_rows"), int(whole["n"]))
    rows, given = [], {}
    try:
        for step, space in enumerate(spaces):
            found = run_trials(space, _scores(name, dealt, int(whole["last"]) + 1, int(whole["n"]), seed, given), trials * (1 + step), folds, seed + step)
            best = max((t for t in found if not t.pruned), key=lambda t: t.metric)
            rows += [(step + 1, i, json.dumps(given | t.params, sort_keys=True), len(t.scores), t.metric, t.pruned, t is best) for i, t in enumerate(found)]
            given = given | best.params
    finally:
        dealt.unpersist()
    return spark.createDataFrame(rows, "step int, trial int, params string, folds int, metric double, pruned boolean, is_best boolean")
