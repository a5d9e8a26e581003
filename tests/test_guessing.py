"""Guesses of lines by scope, under known lines and outside dead zones; repeated clustering against its loop."""

from __future__ import annotations

import numpy as np
import pytest

from lumenframe.kernels import peaks
from lumenframe.operators import guessing
from lumenframe.operators.guessing import Known
from lumenframe.schema import SPECTRA

X = np.linspace(0, 300, 301)


def curve(*lines):
    return sum(peaks.gaussian(X, a, x0, dx) for a, x0, dx in lines)


def test_known_lines_are_kept_and_dead_zones_stay_free():
    y = curve((5.0, 60, 8), (3.0, 150, 8), (4.0, 240, 8)) + np.random.default_rng(1).normal(0, 0.01, len(X))
    free, n = guessing.pursue(X, y, fwhm=16)
    assert n == 0 and all(min(abs(free.values.reshape(-1, 3)[:, 1] - c)) < 1 for c in (60, 150, 240))
    fitted, n = guessing.pursue(X, y, fwhm=16, known=[Known(2.5, 152, 8)], forbidden=[(215, 265)])
    lines = fitted.values.reshape(-1, 3)
    assert n == 1 and abs(lines[0, 1] - 150) < 3 and any(abs(v - 60) < 1 for v in lines[1:, 1])
    low = [peaks.line_bounds("Gaussian", float(k), 1.0, 16, 5.0)[1][1] for k in (215, 265)]
    assert not any(low[0] + 8 < v < 260 for v in lines[1:, 1]) and not any(215 + 6 < v < 265 - 6 for v in lines[1:, 1])


def test_a_dead_zone_holds_even_where_its_line_was_moved():
    """A line that the fit moved leaves a residual in its zone: no second guess falls there."""
    y = curve((5.0, 60, 8)) + 0.5 * curve((1.0, 63, 2))
    fitted, _ = guessing.pursue(X, y, fwhm=16, noise=0.05)
    at = fitted.values.reshape(-1, 3)[:, 1]
    top = int(np.argmax(y))
    assert sum(abs(v - X[top]) < 4 for v in at) == 1
    nothing, n = guessing.pursue(X, np.zeros(len(X)), fwhm=16, noise=0.1)
    assert nothing is None and n == 0
    alone, n = guessing.pursue(X, y, fwhm=16, known=[Known(5.0, 60, 8), Known(1.0, 900, 8)], most=1)
    assert n == 1 and len(alone.values) == 3


def test_guess_of_spectra_numbers_known_lines(spark):
    rows = [(i, i % 2, X.tolist(), (curve((5.0, 60 + i, 8), (4.0, 240, 8))).tolist()) for i in range(3)] + [(9, 0, [], []), (10, 0, [1.0, 2.0], [1.0, 1.0])]
    got = guessing.guess(spark.createDataFrame(rows, SPECTRA), [150.0], fwhm=16, known=[Known(1.0, 240, 8), Known(1.0, 60, 8)], noise=0.1).collect()
    assert {(r.key, r.interval, r.known) for r in got if r.known is not None} == {(k, 0, 1) for k in range(3)} | {(k, 1, 0) for k in range(3)}
    assert all(abs(r.x0 - 240) < 1 for r in got if r.known == 0)
    assert guessing.guess(spark.createDataFrame([], SPECTRA)).count() == 0


def looped(groups, reach, repeats, seed, interval, starts):
    """The same clustering by its loop, on lines one by one."""
    lines = sorted(v for g in groups.values() for v in g)
    runs = []
    for r in range(repeats):
        clusters = guessing.first_clusters(*starts[r], reach)
        for k in np.random.default_rng([seed, interval, r]).permutation(len(lines)):
            d = [abs(np.mean(c) - lines[k]) for c in clusters]
            if min(d) <= reach:
                clusters[int(np.argmin(d))].append(lines[k])
            else:
                clusters.append([lines[k]])
        runs.append(sorted(float(np.mean(c)) for c in clusters))
    sizes = [len(r) for r in runs]
    wanted = max(sorted(set(sizes)), key=lambda s: sizes.count(s))
    clusters = [[float(c)] for c in np.median([r for r in runs if len(r) == wanted], axis=0)]
    for v in lines:
        d = [abs(np.mean(c) - v) for c in clusters]
        if min(d) <= reach:
            clusters[int(np.argmin(d))].append(v)
        else:
            clusters.append([v])
    return sorted((float(np.mean(c)), float(np.std(c))) for c in clusters)


def test_repeated_clustering_equals_its_loop(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    groups = {i: {k: sorted(float(v) for v in np.array([50.0, 71.0, 90.0])[rng.random(3) < 0.8] + rng.normal(0, 2.5, 3)[: (rng.random(3) < 2).sum()][0]) for k in range(12)} for i in (0, 4)}
    rows = [(k, i, v) for i, g in groups.items() for k, lines in g.items() for v in lines]
    df = spark.createDataFrame(rows, "key long, interval int, x0 double")
    hwhm, repeats = 12.0, 5
    hashes = {(k, s): h for k in range(12) for s, h in [(s, spark.range(1).select(F.xxhash64(F.lit(k).cast("long"), F.lit(7), F.lit(s)).alias("h")).first().h) for s in range(2 * repeats)]}
    got = guessing.clustered(df, hwhm, repeats, 7, bins=10**6).orderBy("interval", "line").collect()
    for i, g in groups.items():
        held = {k: v for k, v in g.items() if v}
        pick = lambda s: held[min(held, key=lambda k: hashes[k, s])]  # noqa: B023, E731
        want = looped(held, hwhm / 2 + 1, repeats, 7, i, [(pick(2 * s), pick(2 * s + 1)) for s in range(repeats)])
        own = [(r.x0, r.sd) for r in got if r.interval == i]
        assert [a for a, _ in own] == pytest.approx([a for a, _ in want]) and [b for _, b in own] == pytest.approx([b for _, b in want], abs=1e-6)
    assert guessing.clustered(df.limit(0), hwhm).count() == 0


def test_most_frequent_number_and_medians():
    runs = [np.array([1.0, 9.0]), np.array([5.0]), np.array([10.0, 2.0]), np.array([3.0, 11.0])]
    assert guessing.middle_centres(runs).tolist() == [2.0, 10.0]


@pytest.mark.parametrize("scope", guessing.SCOPES)
def test_templates_of_every_scope_find_the_lines(spark, scope):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, X.tolist(), (curve((5.0 + i % 3, 60 + rng.normal(0, 1), 8), (4.0, 120, 8), (3.0, 240 + rng.normal(0, 1), 8)) + rng.normal(0, 0.02, len(X))).tolist()) for i in range(24)]
    df = spark.createDataFrame(rows, SPECTRA)
    lines = guessing.template(df, scope, fwhm=16, borders=[180.0])
    got = lines.orderBy("line").collect()
    strong = [r for r in got if r.a > 1]
    assert [round(r.x0) for r in strong] == pytest.approx([60, 120, 240], abs=1) and [r.line for r in got] == list(range(len(got)))
    assert all(r.low <= r.x0 <= r.high and abs(r.dx - 8) < 1.5 for r in strong) and [r.interval for r in strong] == [0, 0, 1]
    if scope == "Average groups":  # by hand: group means, guesses, clusters
        means = {g: np.mean([r[3] for r in rows if r[1] == g], axis=0) for g in range(3)}
        found = [v for m in means.values() for part in peaks.split_by_borders(X, [180.0]) for v in guessing.pursue(X[part], m[part], fwhm=16)[0].values.reshape(-1, 3)[:, 1]]
        for r in strong:
            near = [v for v in found if abs(v - r.x0) < 8]
            assert abs(np.mean(near) - r.x0) <= max(1.0, r.sd) + 1e-6
    fitted = guessing.fit_template(df, lines.where("a > 1"), fwhm=16).collect()
    assert len(fitted) == 72 and np.mean([r.r2 for r in fitted]) > 0.95
    with pytest.raises(ValueError, match="no scope"):
        guessing.template(df, "Some")
