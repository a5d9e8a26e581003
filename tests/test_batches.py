"""Kernels of many spectra at once: what a task holds, how work is dealt, and the same results as one by one."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pytest

from lumenframe.kernels import baseline, linalg, many_fits, optimizers, peaks, smooth
from lumenframe.operators import decompose
from lumenframe.plans import pipeline
from lumenframe.schema import SPECTRA


def test_a_task_holds_few_long_spectra_at_a_time():
    whole = pd.DataFrame({"key": range(1000), "y": [np.zeros(1000)] * 998 + [None, np.zeros(10**6)]})
    got = list(pipeline.pieces(iter([whole])))
    assert [k for b in got for k in b["key"]] == list(range(1000))
    assert max(sum(0 if y is None else len(y) for y in b["y"]) for b in got[:-1]) <= pipeline.PIECE_POINTS and len(got[-1]) == 1


def test_kernels_are_dealt_into_small_tasks(spark):
    assert pipeline.dealt(spark.range(10**6)).rdd.getNumPartitions() == 10**6 * 8 // pipeline.DEALT_BYTES + 1


def test_baselines_on_an_axis_are_those_of_the_drawn_spectra(spark):
    x, places = [float(v) for v in range(30)], np.linspace(0, 29, 77)
    rows = [(k, 1, x, [float(np.sin(k + v / 3) + v) for v in x]) for k in range(9)] + [(9, 1, [], []), (10, 1, None, None)]
    got = {r.key: r for r in pipeline.with_baselines(spark.createDataFrame(rows, SPECTRA), "Poly", places).collect()}
    drawn = [(k, 1, places.tolist(), np.interp(places, x, y).tolist()) for k, _, _, y in rows[:9]]
    want = {r.key: r for r in pipeline.with_baselines(spark.createDataFrame(drawn, SPECTRA), "Poly").collect()}
    assert {k for k in got if got[k].y} == set(want) and got[9].baseline == [] and 10 not in got
    for k, r in want.items():
        assert got[k].baseline == pytest.approx(r.baseline) and got[k].y == r.y


def test_weights_that_vanish_beside_the_penalty():
    y, t = np.random.default_rng(3).normal(size=64), np.arange(64.0)
    assert linalg.whittaker(y, np.full(64, 1e-12), 1e5) == pytest.approx(linalg.polynomial(t, y, 1), abs=1e-5)
    w = np.zeros(64)
    w[[3, 40]] = 1e-14
    assert linalg.whittaker(y, w, 1e5)[[3, 40]] == pytest.approx(y[[3, 40]], abs=1e-5)


@pytest.mark.parametrize("method", ["leastsq", *many_fits.METHODS])
def test_fits_of_many_rows_are_those_of_single_rows(method):
    x, rng = np.linspace(300, 700, 21), np.random.default_rng(5)
    y = np.stack([a * np.exp(-(((x - 480 - s) / 40) ** 2)) + rng.normal(0, 0.05, 21) for a, s in ((1.0, 0), (0.3, 9), (0.0, 0))])
    bounds = [peaks.line_bounds("Gaussian", 500.0, max(v.max() / 2, 1e-9), 80.0, max(v.max(), 1e-9)) for v in y]
    start, low, high = (np.array([b[j] for b in bounds]) for j in range(3))
    many = peaks.fit_many(x, y, ["Gaussian"], start, low, high, partial(many_fits.minimise, method))
    solver = peaks.least_squares if method == "leastsq" else partial(optimizers.minimise, method)
    for k, r in enumerate(many):
        one = peaks.fit(x, y[k], ["Gaussian"], start[k], low[k], high[k], solver=solver)
        assert r.values == pytest.approx(one.values, abs=1e-4) and r.chisqr == pytest.approx(one.chisqr, rel=1e-9)


@pytest.mark.parametrize("shape", peaks.SHAPES)
def test_shapes_of_many_rows(shape):
    x = np.linspace(0, 100, 31)
    p = np.array([peaks.line_bounds(shape, v, 1.0, 20.0, 2.0)[0] for v in (30.0, 61.0)])
    assert peaks.models(x, [shape])(p) == pytest.approx(np.stack([peaks.model(x, [shape])(v) for v in p]), rel=1e-12)


def test_a_failing_spectrum_costs_no_other_its_fit(spark):
    x = [300.0 + 20 * i for i in range(30)]
    rows = [(k, 1, x, [float(np.exp(-(((v - 500) / 40) ** 2)) + (np.nan if k == 2 and v == 500 else 0)) for v in x]) for k in range(4)] + [(4, 1, x[:20], [1.0] * 20)]
    got = decompose.fits(spark.createDataFrame(rows, SPECTRA), [500.0], "Pseudo Voigt", 80.0).select("key", "r2").collect()
    assert {r.key for r in got} >= {0, 1, 3, 4} and min(r.r2 for r in got if r.key in (0, 1, 3)) > 0.99


@pytest.mark.parametrize("name", smooth.MANY)
def test_modes_of_many_rows_are_those_of_single_rows(spark, name):
    rng = np.random.default_rng(1)
    ys = [rng.normal(size=n) + np.sin(np.arange(n)) for n in (40, 40, 33, 2, 40)] + [np.zeros(40), np.arange(33.0)]
    rows = [(k, 1, np.arange(len(y), dtype=float).tolist(), y.tolist()) for k, y in enumerate(ys)] + [(8, 1, [], []), (9, 1, None, None)]
    got = {r.key: r.y for r in pipeline.run_kernels(spark.createDataFrame(rows, SPECTRA), [pipeline.Step("smooth", name)]).collect()}
    assert got.pop(8) == [] and got.pop(9) is None
    for k, y in enumerate(ys):
        own = {"seed": pipeline.seed_of(k)} if name in smooth.SEEDED else {}
        assert got[k] == smooth.SMOOTHERS[name](None, y, **own).tolist()


def test_extremes_of_windows_that_double():
    for n, half in ((64, 5), (7, 3), (3, 8), (1, 4), (50, 1), (50, 0)):
        y = np.random.default_rng(n).normal(size=n)
        assert (linalg.erode(y, half) == linalg.running(y, half, np.min)).all() and (linalg.dilate(y, half) == linalg.running(y, half, np.max)).all()


def test_the_smoothing_kernel_is_made_once(monkeypatch):
    made, real = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda m: made.append(1) or real(m))
    baseline.METHODS["IPSA"](np.arange(64.0), np.random.default_rng(0).normal(size=64), half_window=5)
    assert len(made) == 1


@pytest.mark.parametrize("name", [*baseline.MANY, *smooth.MANY_ON_AXIS])
def test_methods_of_many_rows_are_those_of_single_rows(spark, monkeypatch, name):
    rng, kind = np.random.default_rng(1), "baseline" if name in baseline.MANY else "smooth"
    table = baseline.METHODS if kind == "baseline" else smooth.SMOOTHERS
    one, calls, rows = table[name], [], []
    for k, (n, size) in enumerate(((64, 1), (64, 0), (33, 1), (64, 50), (9, 1), (2, 1), (1, 1), (64, 1e-9), (64, 1))):
        x = np.arange(float(n)) * (2 if k == 8 else 1)
        rows.append((k, 1, x.tolist(), (size * (rng.normal(size=n) + 5 * np.exp(-((np.arange(n) - n / 3) ** 2) / 20))).tolist()))
    spectra = [np.array(r[2]) for r in rows], [np.array(r[3]) for r in rows]
    want = [one(*own) for own in zip(*spectra, strict=True)]
    odd = [(20, 1, [], []), (21, 1, None, None)]
    got = {r.key: r.y for r in pipeline.run_kernels(spark.createDataFrame(rows + odd, SPECTRA), [pipeline.Step(kind, name)]).collect()}
    assert got.pop(20) == [] and got.pop(21) is None
    for k, (y, w) in enumerate(zip(spectra[1], want, strict=True)):
        assert got[k] == pytest.approx((y - w if kind == "baseline" else w).tolist(), abs=1e-5 * max(np.abs(y).max(), 1e-12)), k
    monkeypatch.setitem(table, name, lambda x, y: calls.append(len(y)) or one(x, y))
    many = pipeline._kernel_of_many(pipeline.Step(kind, name))
    many([0, 1, 2], [spectra[0][0]] * 3, [spectra[1][0], spectra[1][3], np.where(np.arange(64) == 5, np.nan, spectra[1][0])] if name == "Goldindec" else [spectra[1][0]] * 3)
    assert calls == ([64] if name == "Goldindec" else [])  # values that aren't finite go alone


def test_solvers_of_many_rows_equal_dense_ones():
    rng = np.random.default_rng(2)
    for n, reach in ((40, 6), (12, 4), (3, 1), (1, 1)):
        bands = {o: rng.normal(size=(5, n)) * (np.arange(n) < n - o) for o in range(reach + 1)}
        bands[0] = bands[0] + 30
        full = np.stack([sum(np.diag(v[r][: n - o], o) + (np.diag(v[r][: n - o], -o) if o else 0) for o, v in bands.items() if o < n) for r in range(5)])
        b = rng.normal(size=(5, n))
        assert linalg.solve_banded_many(bands, b) == pytest.approx(np.linalg.solve(full, b[..., None])[..., 0])
    mid = 3 + rng.random((5, 20))
    full = np.stack([np.diag(m) - np.eye(20, k=1) - np.eye(20, k=-1) for m in mid])
    b = rng.normal(size=(5, 20))
    assert linalg.solve_tridiagonal(-1.0, mid, b) == pytest.approx(np.linalg.solve(full, b[..., None])[..., 0])
