"""Known values of the column functions and properties of the kernels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import labels
from lumenframe.kernels import baseline, linalg, optimizers, peaks, signal, smooth, special
from lumenframe.operators import aggregates, decompose, learning, relational, search, statistics, tests_of_groups
from lumenframe.plans.pipeline import Step, apply, plan, spread
from lumenframe.schema import SPECTRA, to_points, to_spectra
from lumenframe.sources import project, spectra_text

X = np.linspace(300, 1800, 200)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_known_values_of_arrays(spark):
    v = lambda c: value(spark, c)
    assert v(A.nearest(arr(1, 2, 3, 4, 5), 2.9)) == 2
    assert v(A.nearest(arr(1, 2, 3, 4, 5), 2.5)) == 1
    assert v(A.nearest_stepping_back(arr(100, 150, 200, 250, 300), 260.0)) == 3
    assert v(A.min_max(arr(1, 2, 3, 4, 5))) == [0, 0.25, 0.5, 0.75, 1]
    assert v(A.diff(arr(1, 2, 4, 7, 0))) == [0, 1, 2, 3, -7]
    bools = lambda s: F.array(*[F.lit(c == "1") for c in s])
    text = lambda r: "".join("1" if b else "0" for b in r)
    assert text(v(A.dilate(bools("0000011100000"), 3))) == "0001111111000"
    assert text(v(A.dilate(bools("010001000"), 2))) == "111011100"  # the left edge keeps its mark
    assert text(v(A.dilate_left(bools("000111000"), 2))) == "001111000"
    assert text(v(A.dilate_left(bools("010001000"), 2))) == "110011000"
    assert v(A.minima(arr(5, 3, 1, 4, 2))) == [2]
    assert v(A.interpolate(arr(1, 2, 3), arr(2, 4, 6), [1.5, 2.5, 3.5])) == [3, 5, 6]
    assert v(A.trapezoid(arr(0, 1, 3), arr(2, 2, 4))) == 8
    assert v(A.plateau(arr(1, 9, 9, 9, 2, 9))) == 2
    assert v(A.fluorescence_start(arr(*range(0, 350, 50)), arr(1, 2, 1, 5, 7, 4, 3), 1, 100.0)) == 4


def test_names(spark):
    v = lambda c: value(spark, c)
    for name, grp in (("1_spectrum.txt", 1), ("[2]_spectrum.txt", 2), ("spectrum.txt", 0), ("(34)a.asc", 3), ("[12]a.txt", 0)):
        assert v(labels.group_of(F.lit(name))) == grp
    assert v(labels.legend(F.lit(575.31))) == "k575dot31_" and v(labels.legend_value(F.lit("k956dot76_"))) == 956.76
    assert tuple(v(labels.parameter_parts(F.lit("Curve_10_x0")))) == (10, "x0")


def test_mean_of_two_spectra(spark):
    df = spark.createDataFrame([(1, 1, [1.1], [1.1]), (2, 1, [1.2], [1.2])], SPECTRA)
    got = aggregates.group_average(to_points(df)).first()
    assert got.y == pytest.approx(1.15)
    assert to_spectra(to_points(df)).orderBy("key").collect() == df.orderBy("key").collect()


def synthetic(seed=42):
    rng = np.random.default_rng(seed)
    t = (X - 300) / 1500
    base = 200 * np.exp(-1.5 * t) + 30 * t
    lines = peaks.gaussian(X, 60, 600, 20) + peaks.gaussian(X, 80, 1000, 25) + peaks.lorentzian(X, 40, 1400, 15)
    return base, base + lines + rng.normal(0, 0.5, len(X))


@pytest.mark.parametrize("name", sorted(baseline.METHODS))
def test_baselines_are_whole_and_finite(name):
    base, y = synthetic()
    z = baseline.METHODS[name](X, y.copy())
    assert z.shape == y.shape and np.isfinite(z).all()
    flat = baseline.METHODS[name](X, np.full(len(X), 7.0))
    assert np.isfinite(flat).all()


@pytest.mark.parametrize("name", ["ModPoly", "iModPoly", "ExModPoly", "arPLS", "AsLS", "drPLS", "asPLS", "psaLSA", "Quantile regression", "Penalized poly", "Dietrich", "FABC", "SNIP", "Mixture Model", "IRSQR", "BEaDS"])
def test_baselines_come_near_the_true_one(name):
    base, y = synthetic()
    stiff = {"lam": 1e4} if name in ("AsLS", "arPLS", "drPLS", "asPLS", "psaLSA", "FABC") else {}
    assert np.mean(np.abs(baseline.METHODS[name](X, y, **stiff) - base) / base) < 0.04


def test_polynomials_are_reproduced():
    y = np.polyval([2, -1, 3], (X - 1000) / 700)
    for name in ("Poly", "ModPoly", "iModPoly", "ExModPoly"):
        assert np.allclose(baseline.METHODS[name](X, y, poly_order=3), y, atol=1e-6)


def test_banded_solver_equals_dense():
    rng = np.random.default_rng(0)
    y, w = rng.normal(size=60), rng.random(60) + 0.1
    for order in (1, 2, 3):
        dense = np.linalg.solve(np.diag(w) + 5 * linalg.penalty(60, order), w * y)
        assert np.allclose(linalg.whittaker(y, w, 5.0, order), dense)
    assert np.allclose(smooth.whittaker(X, np.arange(200.0), 0.0), np.arange(200.0))


@pytest.mark.parametrize("name", sorted(smooth.SMOOTHERS))
def test_smoothers_lower_the_noise(name):
    clean = peaks.gaussian(X, 60, 700, 60)
    y = clean + np.random.default_rng(1).normal(0, 2, len(X))
    assert np.std(smooth.SMOOTHERS[name](X, y) - clean) < np.std(y - clean)


def test_scatter_correction_recovers_the_reference():
    ref = peaks.gaussian(X, 60, 700, 60)
    assert np.allclose(smooth.emsc(X, 2 * ref + 5, ref), ref, atol=1e-8)


def test_special_functions():
    assert special.wofz(np.array([1 + 1j]))[0] == pytest.approx(0.304744205 + 0.208218938j, abs=1e-8)
    assert special.f_sf(3.5, 2, 20) == pytest.approx(0.0497350, abs=1e-6)
    assert special.mann_whitney_p(2, 5, 5, 0) == pytest.approx(8 / 252)
    assert special.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-5)
    assert special.log_gamma(np.array([5.0 + 0j]))[0].real == pytest.approx(np.log(24))


@pytest.mark.parametrize("shape", sorted(peaks.SHAPES))
def test_fits_recover_a_line(shape):
    start, low, high = peaks.line_bounds(shape, 900.0, 40.0, 80.0, 60.0)
    true = np.array(start)
    true[:3] = (50, 905, 35)
    y = peaks.SHAPES[shape].f(X, *true)
    r = peaks.fit(X, y, [shape], start, low, high)
    assert r.r2 > 0.995
    top, bottom = peaks.band(r)
    assert (top >= bottom).all()


def test_guess_and_clusters():
    y = peaks.gaussian(X, 60, 600, 25) + peaks.gaussian(X, 80, 1000, 40)
    places, r = peaks.guess(X, y, "Gaussian", 60, 4)
    assert r.r2 > 0.99 and any(abs(p - 600) < 5 for p in places) and any(abs(p - 1000) < 5 for p in places)
    groups = [np.array([100 + e, 200 - e]) for e in (0.0, 1.0, 2.0)]
    assert peaks.cluster_places(groups, 10, 1) == peaks.cluster_places(groups, 10, 1) == [101.0, 199.0]
    assert [(s.start, s.stop) for s in peaks.split_by_borders(np.arange(9.0), [2, 5])] == [(0, 2), (2, 5), (5, 9)]


def test_despike_finds_both():
    x = np.linspace(780, 940, 1600)
    y = 100 + peaks.gaussian(x, 500, 850, 4) + np.random.default_rng(1).normal(0, 1, 1600)
    spiked = y.copy()
    spiked[[700, 1100]] += (400, 300)
    out, found = peaks.despike(x, spiked, 784.8, 0.6)
    assert len(found) == 2 and np.abs(out - y)[[700, 1100]].max() < 60


def test_pipeline_fuses_kernels(spark):
    steps = [Step("cut", params={"start": 400.0, "end": 1500.0}), Step("baseline", "arPLS"), Step("smooth", "Whittaker", {"lam": 2.0}), Step("normalize", "SNV")]
    assert [k for k, _ in plan(steps)] == [False, True, False]
    df = spark.createDataFrame([(1, 0, X.tolist(), synthetic()[1].tolist()), (2, 0, [], []), (3, 1, X.tolist(), synthetic(3)[1].tolist())], SPECTRA)
    out = apply(df, steps, where=F.col("key") != 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    rows = out.collect()
    assert len(rows) == 2 and all(abs(np.mean(r.y)) < 1e-9 and abs(np.std(r.y) - 1) < 1e-9 for r in rows)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2_a.txt").write_text("# x y\n1.0  2.5\n2.0\t3.5\n")
    (tmp_path / "in" / "b.ASC").write_text("5 6\n")
    (tmp_path / "in" / "c.csv").write_text("5 6\n")
    got = {r.filename: r for r in spectra_text.read(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"2_a.txt", "b.ASC"} and got["2_a.txt"].grp == 2 and got["2_a.txt"].y == [2.5, 3.5]
    known = spark.createDataFrame([("b.ASC",)], "filename string")
    assert spectra_text.read(spark, str(tmp_path / "in"), known).count() == 1
    df = spark.createDataFrame([(7, 0, [1.0, 2.0], [2.5, 3.5])], SPECTRA)
    spectra_text.write(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).orderBy("value").first().value == "   1.00000    2.50000"
    project.save(spark, str(tmp_path / "p"), {"input": df, "params": df}, {"laser": 785}, production=True)
    stages, settings = project.load(spark, str(tmp_path / "p"))
    assert set(stages) == {"params"} and settings == {"laser": 785}


def test_discriminant_separates(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, [0.0, 1.0], (rng.normal(size=2) + 4 * (i % 2)).tolist()) for i in range(200)]
    df = learning.dataset(spark.createDataFrame(rows, SPECTRA))
    out = learning.train_and_predict(df, "LDA").toPandas()
    assert (out.label == out.prediction).mean() > 0.97 and out.is_test.sum() == 40
    again = statistics.stratified_split(df.repartition(7), "label", "key", 20).where("is_test").select("key")
    assert {r.key for r in again.collect()} == set(out[out.is_test].key)


def test_batch_fits(spark):
    y = peaks.gaussian(X, 60, 600, 25) + peaks.gaussian(X, 80, 1000, 40)
    df = spark.createDataFrame([(1, 0, X.tolist(), y.tolist()), (2, 0, [], [])], SPECTRA)
    got = {(r.line, r.param): r.value for r in decompose.fit_batch(df, [605.0, 990.0], "Gaussian", 60.0, [800.0]).collect()}
    assert got[0, "x0"] == pytest.approx(600, abs=0.5) and got[1, "a"] == pytest.approx(80, abs=0.5)
    assert decompose.dataset(decompose.fit_batch(df, [605.0, 990.0], "Gaussian", 60.0)).first().features[1] == pytest.approx(80, abs=0.5)


def test_running_totals_and_numbers_equal_plain_windows(spark):
    from pyspark.sql import Window

    from lumenframe.operators import relational

    df = spark.range(3000).select((F.col("id") % 7 == 0).alias("g"), (F.xxhash64("id") / 1e15).alias("v"), (F.col("id") % 5).alias("n"))
    w = Window.partitionBy("g").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.g, r.v, r.c) for r in df.withColumn("c", F.sum("n").over(w)).collect()}
    assert {(r.g, r.v, r.cum_n) for r in relational.running_totals(df, "v", ["n"], ["g"], descending=True).collect()} == want
    few = spark.createDataFrame([(1.0, 2), (float("nan"), 3), (None, 9), (float("-inf"), 1)], "v double, n int")
    assert [r.cum_n for r in relational.running_totals(few, "v", ["n"]).orderBy("v").collect()] == [1, 3, 6]
    assert relational.running_totals(few.where("false"), "v", ["n"]).count() == 0
    got = relational.hash_numbered(df.withColumn("k", F.monotonically_increasing_id()), "k", 3, ["g"]).groupBy("g").agg(F.countDistinct("hash_no").alias("d"), F.max("hash_no").alias("m"), F.max("hash_rows").alias("r"), F.min("hash_no").alias("o")).collect()
    assert len(got) == 2 and all(r.d == r.m == r.r and r.o == 1 for r in got)


def _by_hand(x, own, n_features):
    """Shapley values over all coalitions of the leaves' game."""
    from itertools import combinations
    from math import factorial

    def game(known):
        total = 0
        for value, feats, lo, hi, share in own:
            total = total + value * np.prod([float(lo[i] < x[f] <= hi[i]) if f in known else share[i] for i, f in enumerate(feats)])
        return total

    out = []
    for f in range(n_features):
        rest = [g for g in range(n_features) if g != f]
        out.append(sum(factorial(k) * factorial(n_features - k - 1) / factorial(n_features) * (game({*c, f}) - game(set(c))) for k in range(n_features) for c in combinations(rest, k)))
    return np.array(out)


@pytest.mark.parametrize("name", ["Decision Tree", "Random Forest", "XGBoost"])
def test_tree_contributions_equal_all_coalitions(spark, name):
    from pyspark.ml.functions import array_to_vector

    from lumenframe.operators import explain

    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    rows = [(i, float(y[i]), [float(v) for v in x[i]], 1.0) for i in range(len(x))]
    df = spark.createDataFrame(rows, "key long, label double, f array<double>, weight double").select("key", "label", array_to_vector("f").alias("features"), "weight")
    small = {"Decision Tree": {"maxDepth": 4}, "Random Forest": {"numTrees": 3, "maxDepth": 3}, "XGBoost": {"rounds": 2, "max_depth": 3}}[name]
    model = learning.estimator(name, **small).fit(df)
    own = explain.leaves(model)
    base, phi = explain.shapley(x, own)
    for i in range(5):
        assert np.allclose(phi[i], _by_hand(x[i], own, 4))
    got = explain.tree_contributions(df, model).groupBy("key", "class").agg(F.sum("contribution").alias("s"), F.first("base").alias("b")).collect()
    total = {(r["key"], r["class"]): r.s + r.b for r in got}
    if name == "XGBoost":
        want = {(r.key, k): float(v) for r in model.transform(df).collect() for k, v in enumerate(r.rawPrediction)}
    else:
        want = {(r.key, k): float(p) for r in model.transform(df).collect() for k, p in enumerate(r.probability)}
    assert total.keys() == want.keys() and all(total[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("method", optimizers.METHODS)
def test_fit_methods_find_the_lines(method):
    x, shapes = np.linspace(0, 100, 120), ["Gaussian", "Lorentzian"]
    curve, true = peaks.model(x, shapes), np.array([3.0, 30, 6, 2, 62, 9])
    y = curve(true) + np.random.default_rng(1).normal(0, 0.01, len(x))
    low, high, start = np.array([0, 20, 2, 0, 50, 2.0]), np.array([6, 40, 15, 6, 75, 20.0]), np.array([1.5, 26, 10, 1.0, 66, 5])
    p, jac = optimizers.minimise(method, curve, start, low, high, y)
    assert np.allclose(p, true, rtol=0.01) and jac.shape == (120, 6)
    high[0] = 2.5  # the best height lies outside: the fit ends on the bound
    p, _ = optimizers.minimise(method, curve, start, low, high, y)
    best, _ = optimizers.minimise("least_squares", curve, start, low, high, y)
    assert (p >= low).all() and (p <= high).all() and p[0] == pytest.approx(2.5, abs=0.01)
    assert ((y - curve(p)) ** 2).sum() <= 1.05 * ((y - curve(best)) ** 2).sum()


def test_an_unknown_fit_method_is_refused(spark):
    with pytest.raises(ValueError, match="no fit method"):
        decompose.fits(None, [1.0], method="other")


def test_export_writes_a_folder_for_each_table_with_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, 2.0], "a")], "key long, y array<double>, name string")
    assert project.export(str(tmp_path), {"some": df, "none": df.where("false")}) == ["some"]
    got = spark.read.option("header", "true").csv(f"{tmp_path}/some").first()
    assert (got.key, got.y, got["name"]) == ("1", "[1.5,2.0]", "a") and not (tmp_path / "none").exists()


def test_peaks_by_height_distance_and_width():
    y = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 0.0])
    assert signal.local_maxima(y).tolist() == [1, 4, 7]
    assert signal.find_peaks(y, height=(1.5, 9)).tolist() == [4, 7]
    assert signal.find_peaks(y, distance=4).tolist() == [4]
    assert signal.width_of(np.array([0, 2, 4, 2, 0.0]), 2) == pytest.approx(2)
    assert signal.find_peaks(y, width=(0, 1.5)).tolist() == [1, 7]
    assert not len(signal.find_peaks(np.ones(5))) and not len(signal.find_peaks(np.zeros(0)))


def test_amplitudes_of_a_wave_and_of_an_uneven_axis():
    x = np.arange(64.0)
    f, a = signal.amplitudes(x, np.cos(2 * np.pi * 4 * x / 64))
    assert f[a.argmax()] == pytest.approx(4 / 64) and a.max() == pytest.approx(0.5)
    uneven = np.sort(np.random.default_rng(42).uniform(0, 63, 64))
    assert np.isfinite(signal.amplitudes(uneven, uneven)[1]).all() and len(signal.amplitudes(np.zeros(0), np.zeros(0))[1]) == 0


def test_class_report_counts_a_class_never_predicted(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, predicted int")
    got = {r.label: (round(r.precision, 6), r.recall, round(r.f1, 6), r.support) for r in statistics.class_report(rows).collect()}
    assert got == {0: (0.666667, 1.0, 0.8, 2), 1: (0.0, 0.0, 0.0, 1)}
    assert statistics.misclassified(rows).count() == 1


def test_savgol_kernel_equals_the_expression_and_mlesg_keeps_edge_cases(spark):
    y = np.random.default_rng(42).normal(size=30)
    got = spark.range(1).select(A.savgol(arr(*y), 9, 3).alias("v")).first().v
    assert np.allclose(got, linalg.savgol(y, 9, 3))
    flat, few = np.ones(50), np.arange(5.0)
    assert (smooth.mlesg(np.arange(50.0), flat) == flat).all() and (smooth.mlesg(few, few) == few).all()


def test_mlesg_keeps_peaks_and_flattens_what_lies_between():
    clean = np.exp(-(((X - 900) / 60) ** 2))
    y = clean + 0.02 * np.random.default_rng(42).normal(size=len(X))
    out = smooth.mlesg(X, y, distance=60.0)
    between = np.abs(X - 900) > 250
    assert np.std(out[between]) < 0.6 * np.std(y[between])
    assert abs(out[np.abs(X - 900).argmin()] - 1) < 0.06


def test_normality_takes_every_value(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(size=3000), *rng.normal(size=3000).round(1), 40.0]
    rows = [(k, 0, float(v)) for k, v in enumerate(values)] + [(k, 1, float(v)) for k, v in enumerate(values[:60])] + [(0, 2, None)]
    got = {r.feature: r for r in tests_of_groups.normality(spark.createDataFrame(rows, "key long, feature int, value double")).collect()}
    for feature, own in ((0, values), (1, values[:60])):
        assert np.allclose((got[feature].w, got[feature].p), special.shapiro_wilk(np.array(own)), rtol=1e-6, atol=1e-12)
    assert got[0].w < 0.9 and not got[0].p_valid and got[1].p_valid and (got[2].w, got[2].p) == (1.0, 1.0)


def test_template_takes_the_lines_of_all_spectra(spark):
    keys = spark.range(1101).withColumnRenamed("id", "key")
    early = [r.key for r in keys.orderBy(F.xxhash64("key", F.lit(0))).limit(500).collect()]
    rows = [(k, 0, 500.0 + k % 3) for k in range(1101)] + [(k, 0, 900.0) for k in set(range(1101)) - set(early)]
    got = decompose.template(spark.createDataFrame(rows, "key long, interval int, x0 double"), 40.0).collect()
    assert sorted(r.x0 for r in got) == [501.0, 900.0]
    assert peaks.cluster_counts(np.array([99.0, 100, 102, 200, 300]), np.array([1, 5, 2, 9, 1]), 10, 2, 1) == [100.0, 200.0]


def test_extended_polynomial_is_quantile_regression_at_a_half():
    _, y = synthetic()
    own = baseline.METHODS["ExModPoly"](X, y, quantile=0.05, w_scale_factor=0.5, recalc_y=False, num_std=0.0, max_iter=300, tol=1e-9)
    assert np.abs(own - baseline.METHODS["Quantile regression"](X, y, quantile=0.05, max_iter=300, tol=1e-9)).max() < 0.02
    lower = baseline.METHODS["ExModPoly"](X, y, quantile=0.05, w_scale_factor=0.1, recalc_y=True, num_std=0.0)
    assert lower.mean() < own.mean()


def dense(n, order):
    d = np.diff(np.eye(n), order, axis=0)
    return d.T @ d


def test_banded_systems_equal_dense_ones():
    rng = np.random.default_rng(3)
    for n in (3, 5, 6, 7, 29, 120):
        a = {o: np.where((np.arange(n) + o >= 0) & (np.arange(n) + o < n), rng.random(n), 0.0) for o in range(-2, 3)}
        a[0] = a[0] + 5
        whole = sum(np.diag(np.resize(v, n)[max(0, -o) : n - max(0, o)], o) for o, v in a.items() if abs(o) < n)
        b = rng.random(n)
        assert np.allclose(linalg.solve_banded({o: v for o, v in a.items() if abs(o) < n}, b), np.linalg.solve(whole, b))
        assert np.allclose(linalg.band_times(a, b), whole @ b)
        assert np.allclose(linalg.band_times(linalg.band_product(a, a), b), whole @ whole @ b)


def drpls_dense(y, lam=1e4, p=0.01, eta=0.5, most=50):
    n, w, z = len(y), np.ones(len(y)), np.ones(len(y))
    for t in range(most):
        old, z = z, np.linalg.solve(np.diag(w) + dense(n, 1) + lam * (np.eye(n) - eta * np.diag(w)) @ dense(n, 2), w * y)
        low = (y - z)[y < z]
        if np.linalg.norm(z - old) <= p:
            break
        u = np.exp(t) * (y - z - (2 * low.std() - low.mean())) / low.std()
        w = (1 - u / (1 + np.abs(u))) / 2
    return z


def test_doubly_reweighted_baseline_equals_dense_brute_force():
    _, y = synthetic()
    assert np.allclose(baseline.METHODS["drPLS"](X, y, lam=1e4), drpls_dense(y), atol=1e-3)


def test_quick_baselines_on_long_axes():
    x = np.linspace(300, 1800, 1000)
    y = 200 * np.exp(-1.5 * (x - 300) / 1500) + peaks.gaussian(x, 60, 600, 20) + np.random.default_rng(0).normal(0, 0.5, 1000)
    for name in ("drPLS", "iAsLS", "asPLS", "BEaDS", "arPLS"):
        assert np.isfinite(baseline.METHODS[name](x, y)).all()


def test_likeliest_value_beats_a_search():
    rng = np.random.default_rng(4)
    y, prior = rng.normal(0, 3, 50), rng.normal(0, 3, 50)
    grid = np.linspace(-12, 12, 20001)
    for weight in (0.1, 1.8, 18.0):
        cost = lambda t, y, m: (y - t) ** 2 / (2 * 1.5**2) + weight * np.abs(t - m) ** 0.4  # noqa: B023, E731
        best = smooth.likeliest(y, prior, weight, 1.5)
        assert all(cost(b, v, m) <= cost(grid, v, m).min() + 1e-9 for b, v, m in zip(best, y, prior, strict=True))


def test_relabellings_keep_the_sizes(spark):
    shares = [tests_of_groups.own_in_block(1000, 300, b, 200, 7) for b in range(4)]
    assert (sum(shares) == 300).all() and abs(shares[0].mean() - 300 * 0.256) < 2
    rng = np.random.default_rng(0)
    rows = [(i, 1 if i < 40 else 2, [0.0, 1.0], [float(v) for v in rng.normal(0, 1, 2)]) for i in range(600)]
    apart = [(k, g, x, [y[0] + 3 * (g == 1), y[1]]) for k, g, x, y in rows]
    same, differ = (tests_of_groups.permutation(spark.createDataFrame(r, SPECTRA), 1, 2, 999).first() for r in (rows, apart))
    assert differ.p == pytest.approx(0.001) and same.p > 0.01
    means = [np.mean([r[3] for r in apart if r[1] == g], axis=0) for g in (1, 2)]
    assert differ.stat == pytest.approx(np.linalg.norm(means[0] - means[1]))
    other = tests_of_groups.permutation(spark.createDataFrame(rows, SPECTRA).repartition(5), 1, 2, 999).first()
    assert other.p == same.p


def test_groups_are_compared_by_what_suits_them(spark):
    rng = np.random.default_rng(5)
    rows = lambda draw: [(i, 1 + i % 2, [0.0, 1.0], [float(draw()) + i % 2, float(draw())]) for i in range(80)]
    for draw, want in ((lambda: rng.normal(), {"hotelling"}), (lambda: rng.exponential() ** 2, {"permutation", "mann-whitney"})):
        df = spark.createDataFrame(rows(draw), SPECTRA)
        long = df.select("grp", F.posexplode("y").alias("feature", "value"))
        got = tests_of_groups.compare(df, long, 1, 2, alpha=1e-3, rounds=199).collect()
        assert {r.test for r in got if not r.test.startswith("normality")} == want


def test_nothing_is_cut_by_the_whole_range(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], SPECTRA)
    assert apply(df, [Step("cut", params={"start": 1.0, "end": 3.0000001})]).first().y == [4, 5, 6]
    assert len(apply(df, [Step("cut", params={"start": 1.0, "end": 2.0})]).first().y) < 3


def test_spread_runs_nothing(spark, tmp_path):
    spark.createDataFrame([(1, 1, [1.0], [1.0])], SPECTRA).coalesce(1).write.parquet(f"{tmp_path}/few")
    assert spread(spark.read.parquet(f"{tmp_path}/few")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(10**9)
    assert spread(large) is large


def test_free_index_and_codes(spark):
    free = lambda v: relational.next_free_index(spark.createDataFrame([(i,) for i in v], "i long"), "i").first().i
    assert free([]) == 0 and free([0, 1, 2]) == 3 and free([3, 4, 6, None]) == 5 and free([3, 4, 5]) == 6 and free([9]) == 1
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    codes = relational.encoded(df, "c", "n")
    assert sorted((r.c or "", r.n) for r in codes.collect()) == [("", None), ("a", 0.0), ("b", 1.0), ("b", 1.0)]
    back = relational.decoded(codes.select("n"), codes, "c", "n")
    assert sorted(r.c or "" for r in back.collect()) == ["", "a", "b", "b"]
    assert labels.title("Whittaker", lam=2.0) == "Whittaker (lam: 2.0)"


def test_search_comes_nearer_and_stops_the_poor():
    space = {"a": search.Axis(0.0, 1.0), "b": search.Axis(1, 1000, powers=True, whole=True)}
    found = search.run_trials(space, lambda ps, fold: [-((p["a"] - 0.3) ** 2) - 0.1 * (np.log10(p["b"]) - 2) ** 2 for p in ps], 60, 3, 1)
    best = max(found, key=lambda t: t.metric)
    assert abs(best.params["a"] - 0.3) < 0.15 and 30 < best.params["b"] < 400
    assert any(t.pruned and len(t.scores) < 3 for t in found) and not best.pruned


def test_adaptive_search_of_trees(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [0.0] * 2, [float(i % 2 + rng.normal(0, 0.3)), float(rng.normal())]) for i in range(120)]
    found = search.adaptive(spark, learning.dataset(spark.createDataFrame(rows, SPECTRA)), "Decision Tree", 4).collect()
    assert len(found) == 4 and max(r.metric for r in found) > 0.9 and sum(r.is_best for r in found) == 1


def test_models_are_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, [0.0] * 3, [float(v + i % 3) for v in rng.normal(0, 0.5, 3)]) for i in range(90)]
    df = learning.dataset(spark.createDataFrame(rows, SPECTRA))
    steps = [Step("cut", params={"start": 1.0, "end": 2.0}), Step("normalize", "SNV")]
    model = learning.discriminant(df)
    project.save_model(spark, str(tmp_path), "lda", model, steps)
    again, told = project.load_model(spark, str(tmp_path), "lda")
    assert told == steps and np.array_equal(again.w, model.w) and np.array_equal(again.classes, model.classes)
    tree = learning.estimator("Decision Tree").fit(df)
    project.save_model(spark, str(tmp_path), "tree", tree)
    loaded = project.load_model(spark, str(tmp_path), "tree")[0]
    said = lambda m: [r.prediction for r in m.transform(df).orderBy("key").collect()]
    assert said(loaded) == said(tree)


def _dense(y, w, lam, order=2):
    """(W + lam D'D)^-1 W y by a full matrix."""
    d = np.diff(np.eye(len(y)), order, axis=0)
    return np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)


def test_reweighted_baselines_equal_dense_brute_force():
    """The rounds of the publications, each solved with a full matrix."""
    _, y = synthetic()
    y, x = y[::4], X[::4]

    w = np.ones(len(y))
    for _ in range(10):
        z = _dense(y, w, 1e4)
        w = np.where(y > z, 0.01, 0.99)
    assert np.allclose(baseline.METHODS["AsLS"](x, y, lam=1e4, p=0.01, max_iter=10), z, rtol=1e-6)

    w = np.ones(len(y))
    for _ in range(50):
        z = _dense(y, w, 1e4)
        r = y - z
        m, s = r[r < 0].mean(), r[r < 0].std()
        new = 1 / (1 + np.exp(np.clip(2 * (r - (2 * s - m)) / s, -500, 500)))
        if np.linalg.norm(w - new) / np.linalg.norm(w) < 0.01:
            break
        w = new
    assert np.allclose(baseline.METHODS["arPLS"](x, y, lam=1e4, p=0.01), z, rtol=1e-6)

    w = np.ones(len(y))
    for t in range(1, 51):
        z = _dense(y, w, 1e4, 1)
        r = y - z
        lost = -r[r < 0].sum()
        if lost < 0.01 * np.abs(y).sum():
            break
        w = np.where(r < 0, np.exp(np.minimum(t * np.abs(r) / lost, 700)), 0)
        w[[0, -1]] = np.exp(t * np.abs(r[r < 0]).max() / lost)
    assert np.allclose(baseline.METHODS["airPLS"](x, y, lam=1e4, p=0.01), z, rtol=1e-6)


def test_whittaker_smoother_equals_dense_brute_force():
    _, y = synthetic()
    assert np.allclose(smooth.SMOOTHERS["Whittaker"](X, y, lam=2.0), _dense(y, np.ones(len(y)), 2.0), rtol=1e-8)


def test_fluorescence_starts_of_long_axes_take_seconds(spark):
    """500 spectra of 1000 points; the cost of a place must not grow with the points."""
    import time

    from lumenframe.functions import arrays as A

    rows = spark.range(500).select("id", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: i.cast("double")).alias("x"))
    rows = rows.withColumn("y", F.transform("x", lambda v: F.sin(v / 60 + F.col("id")) * v + F.exp(-((v - 300) / 20) * ((v - 300) / 20)) * 900))
    rows = rows.repartition(4)
    began = time.perf_counter()
    got = {r.id: r.place for r in rows.select("id", A.fluorescence_start(F.col("x"), F.col("y"), 3, 100.0).alias("place")).collect()}
    assert time.perf_counter() - began < 10
    for r in rows.where("id < 20").collect():
        g = np.gradient(np.array(r.y))
        steep = next((i for i in range(100, 1000) if g[i] > g.std()), None)
        want = None if steep is None else next((i for i in range(1000) if i - 2 > steep and (g[i - 2 : i + 1] < 0).all()), None)
        assert got[r.id] == want


def test_the_interpolation_step_reads_the_old_axis(spark):
    """More places than before: a new axis named x must not be read for the old one."""
    rng = np.random.default_rng(4)
    x = np.arange(0.0, 640, 10)
    rows = [(i, 0, x.tolist(), rng.normal(size=64).tolist()) for i in range(3)]
    axis = np.linspace(-20, 700, 150).tolist()
    got = apply(spark.createDataFrame(rows, SPECTRA), [Step("interpolate", params={"axis": axis})]).collect()
    for r in got:
        assert r.x == axis and np.allclose(r.y, np.interp(axis, x, rows[r.key][3]))
    counts = {n: value(spark, F.transform(arr(*range(n)) if n else F.array().cast("array<double>"), lambda v: v)) for n in (0, 1, 2, 7, 8)}
    for n, v in counts.items():
        own = arr(*v) if n else F.array().cast("array<double>")
        assert [value(spark, A.at_or_below(own, F.lit(float(u)))) for u in (-1, 0, 0.5, 1, 6, 9)] == [sum(w <= u for w in v) for u in (-1, 0, 0.5, 1, 6, 9)]


def test_describe_holds_no_group_in_a_task_and_keeps_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, float(v)) for v in (5, 1, 2, 2, 9, 7, -0.0, 0.0)] + [(1, 4.0)] + [(2, None)] + [(None, v) for v in (1.0, None, 3.0)] + [(3, v) for v in (nan, -inf, inf, 1.0, nan, 2.0)] + [(4, 7.5)] * 900 + [(5, v * 1e150) for v in range(-300, 300)]
    df = spark.createDataFrame(rows, "g int, value double").repartition(7)
    quartile = lambda p: F.percentile("value", p)
    of = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), F.max("value").alias("max")]
    plain = lambda rs: sorted(str(r.asDict()) for r in rs)
    whole = lambda d: d.select("n", "min", "q25", "q50", "q75", "max", *(["g"] if "g" in d.columns else []))
    assert plain(whole(aggregates.describe(df, "g")).collect()) == plain(whole(df.groupBy("g").agg(*of)).collect())
    assert plain(whole(aggregates.describe(df)).collect()) == plain(whole(df.agg(*of)).collect())
    assert plain(aggregates.describe(df.where("false")).collect()) == plain(df.where("false").agg(*of).collect()) and not aggregates.describe(df.where("false"), "g").count()
    assert "percentile(" not in aggregates.describe(df, "g")._jdf.queryExecution().toString()  # it holds a group's distinct values in one map
    ties = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 1000 / 7).alias("value"))
    assert plain(whole(aggregates.describe(ties, "g")).collect()) == plain(whole(ties.groupBy("g").agg(*of)).collect())
