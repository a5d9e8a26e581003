"""Boosted trees, support vector classes and the search of settings against brute force."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lumenframe.operators import boosting, learning, search, svc
from lumenframe.schema import SPECTRA


def blobs(seed: int, n: int, classes: int, width: int = 4, spread: float = 1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (classes, width))
    y = np.arange(n) % classes
    return centres[y] + rng.normal(0, spread, (n, width)), y


def frame(spark, x, y, parts: int = 3):
    rows = [(i, float(c), [None if np.isnan(v) else float(v) for v in r], 1.0) for i, (r, c) in enumerate(zip(x, y))]
    nan = F.transform("f", lambda v: F.coalesce(v, F.lit(float("nan"))))
    return spark.createDataFrame(rows, "key long, label double, f array<double>, weight double").select("key", "label", array_to_vector(nan).alias("features"), "weight").repartition(parts)


# -- boosted trees


def plain_boost(x, y, n_classes, cuts, s):
    """Margins of the same method, with all splits tried one by one on rows."""
    margins = np.zeros((len(x), 1 if n_classes == 2 else n_classes))

    def score(g, h):
        v = value(g, h)
        return -(2 * g * v + (h + s.reg_lambda) * v * v + 2 * s.reg_alpha * abs(v))

    def value(g, h):
        v = -np.sign(g) * max(abs(g) - s.reg_alpha, 0) / (h + s.reg_lambda)
        return float(np.clip(v, -s.max_delta_step, s.max_delta_step)) if s.max_delta_step else v

    def grow(rows, g, h, depth):
        """(gain of the split here or None, {row: value})."""
        best, parts = 1e-9, None
        parent = score(g[rows].sum(), h[rows].sum())
        if depth < s.max_depth:
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    for missing_left in (True, False):
                        left = np.array([r for r in rows if (missing_left if np.isnan(x[r, f]) else x[r, f] <= c)], int)
                        right = np.setdiff1d(rows, left)
                        if h[left].sum() >= s.min_child_weight and h[right].sum() >= s.min_child_weight:
                            gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - parent
                            if gain > best + 1e-6:
                                best, parts = gain, (left, right)
        if parts is None:
            return True, {r: value(g[rows].sum(), h[rows].sum()) for r in rows}
        sides = [grow(p, g, h, depth + 1) for p in parts]
        if best < s.gamma and all(leaf for leaf, _ in sides):
            return True, {r: value(g[rows].sum(), h[rows].sum()) for r in rows}
        return False, sides[0][1] | sides[1][1]

    for _ in range(s.rounds):
        g, h = boosting.gradients(margins, y, n_classes, s.scale_pos_weight)
        step = np.zeros_like(margins)
        for k in range(margins.shape[1]):
            for r, v in grow(np.arange(len(x)), g[:, k], h[:, k], 0)[1].items():
                step[r, k] = v * s.learning_rate
        margins = margins + step
    return margins


@pytest.mark.parametrize("classes, settings", [(3, {}), (2, {"scale_pos_weight": 2.0, "gamma": 0.4}), (3, {"reg_alpha": 0.3, "reg_lambda": 0.5, "max_delta_step": 0.7, "gamma": 1.0})])
def test_boosted_trees_equal_the_plain_method(spark, classes, settings):
    x, y = blobs(3, 90, classes, 3, 2.0)
    x[::7, 1] = np.nan
    s = boosting.Settings(rounds=3, max_depth=3, min_child_weight=0.5, **settings)
    df = frame(spark, x, y)
    model = boosting.SoftmaxBoosting(s, bins=8).fit(df)
    got = np.array([r.rawPrediction.toArray() for r in model.transform(df).orderBy("key").collect()])
    assert np.allclose(got, plain_boost(x, y, classes, model.cuts, s), atol=1e-4)


def test_boosted_trees_do_not_depend_on_partitions_and_folds_are_left_out(spark):
    x, y = blobs(4, 240, 3)
    df = frame(spark, x, y).withColumn("fold", (F.floor(F.col("key") / 3) % 3).cast("int"))
    s = boosting.Settings(rounds=12, max_depth=2, subsample=0.7, colsample_bytree=0.8, colsample_bynode=0.6, seed=5)  # over CARRIED rounds
    whole, without = boosting.fit_all(df, 3, [(s, None), (s, 1)], 16)
    again = boosting.fit_all(df.repartition(7), 3, [(s, None)], 16, whole.cuts)[0]
    assert [[t.value for t in r] for r in again.trees] == [[t.value for t in r] for r in whole.trees] and len(whole.trees) == 12
    alone = boosting.fit_all(df.where("fold <> 1"), 3, [(s, None)], 16, whole.cuts)[0]
    assert [[t.value for t in r] for r in alone.trees] == [[t.value for t in r] for r in without.trees]
    test = df.where("fold = 1")
    right = without.transform(test).where("prediction = label").count() / test.count()
    assert right > 0.8
    used = {f for r in whole.trees for t in r for f in t.feature if f >= 0}
    assert used and abs(whole.importances.sum() - 1) < 1e-9


def test_softmax_trees_fit_better_than_one_against_the_rest(spark):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    x, y = blobs(6, 300, 4, 4, 1.6)
    df = frame(spark, x, y).withColumn("fold", (F.floor(F.col("key") / 4) % 2).cast("int"))
    train, test = df.where("fold = 0").persist(), df.where("fold = 1").persist()
    own = boosting.SoftmaxBoosting(boosting.Settings(rounds=10, max_depth=3)).fit(train).transform(test)
    rest = OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=3, seed=1)).fit(train)
    losses = []
    p = np.array([r.probability.toArray() for r in own.orderBy("key").collect()])
    raw = [np.array([r.probability.toArray()[1] for r in m.transform(test.drop("prediction")).orderBy("key").collect()]) for m in rest.models]
    q = np.stack(raw, axis=1)
    label = np.array([int(r.label) for r in test.orderBy("key").collect()])
    for v in (p, q / q.sum(axis=1, keepdims=True)):
        losses.append(-np.log(np.clip(v[np.arange(len(v)), label], 1e-12, 1)).mean())
    assert losses[0] < losses[1] and np.allclose(p.sum(axis=1), 1)


def test_draws_and_shares_of_features():
    keys = np.arange(100_000)
    u = boosting._draws(keys, 7)
    assert (0 <= u).all() and (u < 1).all() and abs(u.mean() - 0.5) < 0.01 and np.array_equal(u[5:9], boosting._draws(keys[5:9], 7)) and (u != boosting._draws(keys, 8)).mean() > 0.99
    rng, allowed = np.random.default_rng(1), np.array([True, False, True, True, True])
    for share, n in ((1.0, 4), (0.5, 2), (0.01, 1)):
        own = boosting._sampled(rng, allowed, share)
        assert own.sum() == n and not own[1]


# -- support vector classes


def test_machines_reach_the_least_cost(spark):
    x, y = blobs(8, 120, 3, 3, 1.5)
    c = 0.7
    model = svc.PairwiseSvc(svc.Settings(c=c, tol=1e-5)).fit(frame(spark, x, y))
    rng = np.random.default_rng(0)
    for j, (a, b) in enumerate(model.pairs):
        own = np.isin(y, (a, b))
        side, xs = np.where(y[own] == a, 1.0, -1.0), x[own]

        def cost(w, bias):
            return (w @ w) / 2 + c * svc.hinge(side * (xs @ w + bias))[0].sum()

        best = cost(model.w[j], model.bias[j])
        w, bias = np.zeros(3), 0.0
        for k in range(20_000):  # plain descent from nought
            slope = c * svc.hinge(side * (xs @ w + bias))[1] * side
            rate = 0.02 / (1 + k / 200)
            w, bias = w - rate * (w + slope @ xs), bias - rate * slope.sum()
        assert best <= cost(w, bias) * 1.001
        assert all(best <= cost(model.w[j] + d[:3], model.bias[j] + d[3]) + 1e-4 for d in rng.normal(0, 0.02, (50, 4)))


def test_probabilities_of_classes_sum_to_one_and_are_calibrated(spark):
    x, y = blobs(9, 600, 4, 3, 2.0)
    df = frame(spark, x, y).withColumn("fold", (F.floor(F.col("key") / 4) % 2).cast("int"))
    model = svc.PairwiseSvc().fit(df.where("fold = 0"))
    rows = model.transform(df.where("fold = 1")).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    p, label = np.array([r.p for r in rows]), np.array([int(r.label) for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    brier = ((p - np.eye(4)[label]) ** 2).sum(axis=1).mean()
    right = np.mean([r.label == r.prediction for r in rows])
    assert right > 0.6 and brier < 0.75 * (1 - 1 / 4)
    top = p.max(axis=1)
    for low, high in ((0.3, 0.6), (0.6, 1.01)):
        part = (top >= low) & (top < high)
        assert part.sum() < 20 or abs((p.argmax(axis=1) == label)[part].mean() - top[part].mean()) < 0.15


def test_coupling_gives_back_what_the_pairs_were_made_of():
    rng = np.random.default_rng(3)
    true = rng.dirichlet(np.ones(5), 40)
    pairs = np.array([(a, b) for a in range(5) for b in range(a + 1, 5)])
    r = np.stack([true[:, a] / (true[:, a] + true[:, b]) for a, b in pairs], axis=1)
    assert np.allclose(svc.coupled(r, pairs, 5), true, atol=1e-6)
    noisy = np.clip(r + rng.normal(0, 0.1, r.shape), 0.01, 0.99)
    p = svc.coupled(noisy, pairs, 5)
    miss = lambda q: sum(((1 - noisy[:, j]) * q[:, a] - noisy[:, j] * q[:, b]) ** 2 for j, (a, b) in enumerate(pairs))
    for _ in range(200):
        other = np.maximum(p + rng.normal(0, 0.01, p.shape), 0)
        assert (miss(p) <= miss(other / other.sum(axis=1, keepdims=True)) + 1e-9).all()


def test_several_settings_in_the_same_passes_equal_each_alone(spark):
    x, y = blobs(10, 90, 3, 3)
    df = frame(spark, x, y).withColumn("fold", (F.floor(F.col("key") / 3) % 3).cast("int"))
    both = svc.fit_all(df, 3, [(svc.Settings(0.1, 1e-4), 0), (svc.Settings(5.0, 1e-4), None)])
    alone = svc.fit_all(df, 3, [(svc.Settings(5.0, 1e-4), None)])[0]
    assert np.allclose(both[1].w, alone.w, atol=5e-3) and np.allclose(both[1].slope, alone.slope, rtol=0.05)
    without = svc.fit_all(df.where("fold <> 0").drop("fold"), 3, [(svc.Settings(0.1, 1e-4), None)])[0]
    assert np.allclose(both[0].w, without.w, atol=5e-3)


# -- search


def test_rungs_promote_the_best_share():
    assert search.promoted(0.9, [0.9]) and search.promoted(0.9, [0.9, 0.5, 0.8]) and not search.promoted(0.8, [0.9, 0.5, 0.8])
    rung = list(np.linspace(0, 1, 8))
    assert [search.promoted(v, rung) for v in rung] == [False] * 6 + [True] * 2


def test_halving_stops_what_the_median_would_keep():
    space = {"a": search.Axis(0.0, 1.0)}
    found = search.run_trials(space, lambda ps, fold: [p["a"] for p in ps], 40, 3, 2)
    first = [t.scores[0] for t in found]
    kept_by_median = [t for i, t in enumerate(found) if t.scores[0] >= np.median(first[: i + 1])]
    stopped = [t for t in kept_by_median if t.pruned and len(t.scores) == 1]
    assert len(stopped) > 5 and sum(len(t.scores) == 3 for t in found) < len(kept_by_median)
    best = max(found, key=lambda t: t.metric)
    assert not best.pruned and best.params["a"] == max(t.params["a"] for t in found)


def test_densities_find_options_and_the_settings_that_belong_to_them():
    space = {"kind": search.Choice(("x", "y", "z")), "share": search.Axis(0.0, 1.0, only=("kind", "y")), "c": search.Axis(1e-3, 1e3, powers=True)}
    score = lambda ps, fold: [(p["kind"] == "y") - abs(p.get("share", 0) - 0.7) - 0.2 * abs(np.log10(p["c"]) - 1) for p in ps]
    found = search.run_trials(space, score, 80, 3, 4)
    assert all(("share" in t.params) == (t.params["kind"] == "y") for t in found)
    late = found[40:]
    assert sum(t.params["kind"] == "y" for t in late) > 0.6 * len(late)
    best = max(found, key=lambda t: t.metric)
    assert best.params["kind"] == "y" and abs(best.params["share"] - 0.7) < 0.15
    again = search.run_trials(space, score, 80, 3, 4)
    assert [t.params for t in again] == [t.params for t in found]


@pytest.mark.parametrize("name", sorted(search.SPACES))
def test_every_space_is_searched(spark, name):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, [0.0] * 2, [float(i % 3 + rng.normal(0, 0.4)), float(rng.normal())]) for i in range(90)]
    df = learning.dataset(spark.createDataFrame(rows, SPECTRA)).repartition(2)
    spaces = [dict(s) for s in search.SPACES[name]]
    if name == "XGBoost":
        spaces[0]["rounds"] = search.Axis(2, 3, whole=True)
    found = search.adaptive(spark, df, name, 3, 2, spaces=spaces).collect()
    steps = {s: [r for r in found if r.step == s] for s in {r.step for r in found}}
    assert [len(steps[s]) for s in sorted(steps)] == [3, 6][: len(spaces)]
    assert all(sum(r.is_best for r in own) == 1 and all(0 <= r.metric <= 1 for r in own) for own in steps.values())
    assert max(r.metric for r in found) > 0.75
    if name == "XGBoost":
        best = json.loads(next(r.params for r in steps[1] if r.is_best))
        assert all(best.items() <= json.loads(r.params).items() for r in steps[2])


def test_a_search_passes_over_its_rows_in_few_tasks_and_scores_them_once(spark, monkeypatch):
    seen, scored, asked = [], spark.sparkContext.accumulator(0), spark.conf.get("spark.sql.shuffle.partitions")

    def scores(name, dealt, *rest):
        seen.append(dealt.rdd.getNumPartitions())
        return lambda settings, fold: [0.5] * len(settings)

    monkeypatch.setattr(search, "_scores", scores)
    x, y = blobs(11, 60, 2, 2)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        search.adaptive(spark, frame(spark, x, y), "Random Forest", 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
    assert seen == [spark.sparkContext.defaultParallelism]

    def model(x):
        scored.add(len(x))
        return np.stack([1 - x[:, 0], x[:, 0]], axis=1)

    assert 0 in search.micro_auc(search._own_probabilities(frame(spark, x, y), [model])) and scored.value == 60


def test_cuts_are_found_once_for_all_fits(spark, monkeypatch):
    calls, real = [], boosting.quantile_cuts
    monkeypatch.setattr(boosting, "quantile_cuts", lambda *a: calls.append(1) or real(*a))
    x, y = blobs(12, 60, 2, 2)
    df = frame(spark, x, y).withColumn("fold", (F.floor(F.col("key") / 2) % 2).cast("int"))
    score = search._scores("XGBoost", df, 2, 60, 0, {"max_depth": 1})
    assert min(score([{"rounds": 1}], 0) + score([{"rounds": 1}], 1)) > 0.6 and len(calls) == 1


@pytest.mark.parametrize("n_classes,settings", [(3, {}), (2, {"scale_pos_weight": 2.0}), (3, {"subsample": 0.7, "colsample_bytree": 0.8, "colsample_bylevel": 0.7, "colsample_bynode": 0.6, "gamma": 0.5, "reg_alpha": 0.1, "max_delta_step": 0.5}), (3, {"gamma": 2.0, "min_child_weight": 4.0})])
def test_a_task_alone_grows_the_trees_of_the_shared_passes(spark, monkeypatch, n_classes, settings):
    monkeypatch.setattr(boosting, "CELLS", 200)  # several nodes at once, and several parts a level
    monkeypatch.setattr(boosting, "AT_ONCE", 50)
    monkeypatch.setattr(boosting, "BY_FEATURE", 30)
    x, y = blobs(21, 240, n_classes, 4)
    x = x + np.random.default_rng(3).normal(0, 1.5, x.shape)
    x[::7, 1] = np.nan
    df = frame(spark, x, y).withColumn("fold", (F.floor(F.col("key") / n_classes) % 3).cast("int")).repartition(3)
    s = [(boosting.Settings(rounds=rounds, max_depth=5, seed=2, **settings), fold) for rounds, fold in ((3, 0), (12, 1))]
    cuts = boosting.quantile_cuts(df, 4, 16)
    shared = boosting.fit_all(df, n_classes, s, 16, cuts)
    table = boosting.gathered(df, cuts, 240, 16)
    keys, label, folds, bins = table.value
    for model, (own, fold) in zip(shared, s, strict=True):
        alone = boosting.Booster(own, n_classes, cuts)
        work = boosting._Gathered(bins, keys, label, folds != fold, alone, 16)
        for r in range(own.rounds):
            grown, real = [], boosting._grow_round
            with monkeypatch.context() as m:
                m.setattr(boosting, "_grow_round", lambda *a: (real(*a), grown.append(a[1][0].booster.trees[-1])))
                work.grow(r)
            assert grown[0] == model.trees[r]
    want = {(i, k): m for i, model in enumerate(shared) for k, m in zip(keys[folds == s[i][1]], model.probabilities(model.margins(np.where(bins == 16, boosting.MISSING, bins)[folds == s[i][1]])), strict=True)}
    got = boosting.held_out(spark, table, n_classes, s, 16).collect()
    assert len(got) == len(want) and np.allclose([list(r.probability) for r in sorted(got, key=lambda r: r.model)], list(want.values()), atol=1e-12)
    assert [r.label for r in sorted(got, key=lambda r: r.model)] == [float(v) for i in range(2) for v in label[folds == s[i][1]]]
    assert sum(f >= 0 for model in shared for trees in model.trees for t in trees for f in t.feature) > 20
    assert boosting.gathered(df, cuts, boosting.GATHERED_BYTES, 16) is None


def test_boosted_trees_are_searched_whole(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(search, "_scores", lambda *a: lambda settings, fold: asked.append(settings) or [p["rounds"] / 1000 if "rounds" in p else 0.5 for p in settings])
    x, y = blobs(22, 30, 2, 2)
    found = search.adaptive(spark, frame(spark, x, y), "XGBoost").collect()
    assert [sum(r.step == s for r in found) for s in (1, 2)] == [20, 40]  # more than START in each, so densities propose
    first, second = search.SPACES["XGBoost"]
    assert (first["rounds"].at(0), first["rounds"].at(1), second["max_depth"].at(0), second["max_depth"].at(1)) == (50, 500, 6, 16)
    assert max(json.loads(r.params)["rounds"] for r in found) > 350


def test_all_classifiers_learn_from_one_split(spark, monkeypatch):
    calls, real = [], learning.statistics.stratified_split
    monkeypatch.setattr(learning.statistics, "stratified_split", lambda *a: calls.append(1) or real(*a))
    x, y = blobs(13, 80, 2, 2)
    df, names = frame(spark, x, y), ("LDA", "Decision Tree", "SVC")
    got = {(r.model, r.key): (r.prediction, list(r.probability)) for r in learning.predict_all(df, names).collect()}
    assert len(calls) == 1 and len(got) == 3 * 80
    for name in names:
        for r in learning.train_and_predict(df, name).collect():
            assert got[name, r.key][0] == r.prediction and got[name, r.key][1] == pytest.approx(list(r.probability), abs=1e-6)


# -- metrics


def test_curves_on_the_grid_equal_interpolation(spark):
    from lumenframe.operators import statistics

    rng = np.random.default_rng(1)
    label = rng.integers(0, 3, 400)
    p = rng.dirichlet(np.ones(3), 400).round(2)  # ties
    p[np.arange(400), label] += 0.3
    cells = spark.createDataFrame([(c, float(p[i, c]), bool(label[i] == c)) for i in range(400) for c in range(3)], "label int, score double, hit boolean")
    got = {(r.curve, r.place): r.tpr for r in statistics.roc_averages(cells, F.col("hit"), "score", "label", 101).collect()}

    def curve(score, hit):
        cuts = sorted(set(score), reverse=True)
        return np.array([0.0, *((score[~hit] >= c).mean() for c in cuts)]), np.array([0.0, *((score[hit] >= c).mean() for c in cuts)])

    grid, each = np.arange(101) / 100, []
    for c in range(3):
        each.append(np.interp(grid, *curve(p[:, c], label == c)))
        assert [got[str(c), k] for k in range(101)] == pytest.approx(each[-1].tolist())
    assert [got["macro", k] for k in range(101)] == pytest.approx(np.mean(each, axis=0).tolist())
    micro = np.interp(grid, *curve(p.ravel(), (np.eye(3)[label] == 1).ravel()))
    assert [got["micro", k] for k in range(101)] == pytest.approx(micro.tolist()) and len(got) == 5 * 101


def test_permuted_features_move_on_and_nothing_else_does(spark):
    x, y = blobs(12, 150, 3, 3)
    df = frame(spark, x, y)
    got = learning.permuted(df, [0, 2], repeats=2, seed=3, dealt=40).select("feature", "repeat", "label", vector_to_array("features").alias("f")).collect()
    key = lambda r: (r["label"], *np.round(r["f"], 9))
    as_is = sorted(key(r) for r in got if r["feature"] == -1)
    assert as_is == sorted((float(c), *np.round(r, 9)) for r, c in zip(x, y))
    for f in (0, 2):
        for repeat in range(2):
            own = [key(r) for r in got if (r["feature"], r["repeat"]) == (f, repeat)]
            rest = [k for k in range(4) if k != f + 1]
            assert sorted(tuple(r[k] for k in rest) for r in own) == sorted(tuple(r[k] for k in rest) for r in as_is)
            assert sorted(r[f + 1] for r in own) == sorted(r[f + 1] for r in as_is) and not set(own) & set(as_is)
    again = learning.permuted(df.repartition(7), [0, 2], repeats=2, seed=3, dealt=40).select("feature", "repeat", "label", vector_to_array("features").alias("f")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_importance_of_the_feature_that_tells_the_classes(spark):
    rng = np.random.default_rng(4)
    y = np.arange(200) % 2
    x = np.stack([y * 4 + rng.normal(0, 0.5, 200), rng.normal(size=200)], axis=1)
    df = frame(spark, x, y)
    model = learning.estimator("Decision Tree").fit(df)
    got = learning.permutation_importance(df, model, [0, 1]).collect()
    assert len(got) == 11 and next(r.f1 for r in got if r.feature == -1) == 1.0
    assert all(0.3 < r.fall < 0.7 for r in got if r.feature == 0) and all(r.fall == 0 for r in got if r.feature == 1)
