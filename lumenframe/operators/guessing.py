"""Guesses of lines: residual pursuit under known lines and outside dead zones, scopes of averages, and repeated clustering to a template.

A guess is two-level where it needs to be: averages of groups (or all spectra) are guessed one by one, their lines
are clustered to common places by interval, and the clusters are fitted to the average spectrum.  The
resulting template has a row a line; it is counted before it is broadcast to the batch fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import labels
from lumenframe.kernels import peaks
from lumenframe.operators import aggregates
from lumenframe.plans.pipeline import spread
from lumenframe.schema import to_points, to_spectra

SCOPES = ("Average", "Average groups", "All")
#: Lines of a template that a batch fit takes; seeded passes of a clustering; places counted as one, as parts of a cluster's reach.
TEMPLATE_ROWS, REPEATS, BINS = 10_000, 15, 50
TEMPLATE = "interval int, line int, legend string, a double, x0 double, dx double, low double, high double, sd double"


@dataclass(frozen=True)
class Known:
    """A line that is there already: its height, place and half width."""

    a: float
    x0: float
    dx: float


def _zone(x: np.ndarray, y: np.ndarray, k: int) -> slice:
    """The places around k that stay above three quarters of its height: no second line is guessed there."""
    low = y <= 0.75 * y[k]
    left, right = np.flatnonzero(low[:k]), np.flatnonzero(low[k:])
    return slice(int(left[-1]) if len(left) else 0, k + int(right[0]) + 1 if len(right) else len(y))


def pursue(x: np.ndarray, y: np.ndarray, shape: str = "Gaussian", fwhm: float | None = None, known: Sequence[Known] = (), forbidden: Sequence[tuple[float, float]] = (), noise: float | None = None, most: int | None = None) -> tuple[peaks.Fit | None, int]:
    """(fit of all lines, how many of them are known): known lines inside the axis come first, in their order, and all are fitted anew with each new line.

    New lines are added at the residual's maximum until it falls under the noise or there are as many
    lines as the axis holds. Dead zones are kept free: half a width around known lines, forbidden
    intervals (both ends included), and what belongs to a guessed line already.
    """
    step = float(np.median(np.diff(x))) if len(x) > 1 else 1.0
    fwhm = fwhm or 6 * step
    noise = noise if noise is not None else 3 * float(np.std(np.diff(y))) / np.sqrt(2)
    most = most or int(4 * (x[-1] - x[0]) / fwhm) + 1
    here = [k for k in known if x[0] <= k.x0 <= x[-1]]
    top = max(float(y.max()), 1e-12)
    parts = [peaks.line_bounds(shape, k.x0, max(k.a, 1e-12), 2 * k.dx, top) for k in here]
    dead = np.zeros(len(x), bool)
    for lo, hi in [*forbidden, *((k.x0 - k.dx / 2, k.x0 + k.dx / 2) for k in here)]:
        dead |= (x >= lo) & (x <= hi)
    fitted, start = None, [p[0] for p in parts]
    while True:
        if parts:
            low, high = (np.concatenate([p[j] for p in parts]) for j in (1, 2))
            fitted = peaks.fit(x, y, [shape] * len(parts), np.clip(np.concatenate(start), low, high), low, high, 30)
            start = list(fitted.values.reshape(len(parts), -1))
        rest = np.where(dead, -np.inf, y - (fitted.curve if fitted else 0.0))
        k = int(np.argmax(rest))
        if len(parts) >= most or not rest[k] > noise:
            return fitted, len(here)
        parts.append(peaks.line_bounds(shape, float(x[k]), float(rest[k]), fwhm, top))
        start.append(np.array(parts[-1][0]))
        dead[_zone(x, np.where(dead, 0.0, rest), k)] = True
        dead[k] = True


def guess(spectra: DataFrame, borders: Sequence[float] = (), shape: str = "Gaussian", fwhm: float | None = None, known: Sequence[Known] = (), forbidden: Sequence[tuple[float, float]] = (), noise: float | None = None) -> DataFrame:
    """key, grp, interval, known (its number among the known lines; null: guessed), a, x0, dx of the lines of each spectrum.

    Spectra without points and intervals of fewer than five have no lines.
    """
    known, forbidden, n_params = list(known), list(forbidden), len(peaks.names(shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, grp, x, y in zip(b["key"], b["grp"], b["x"], b["y"], strict=True):
                x, y = np.asarray(x, float), np.asarray(y, float)
                for i, part in enumerate(peaks.split_by_borders(x, list(borders))):
                    xs, ys = x[part], y[part]
                    if len(xs) < 5:
                        continue
                    fitted, n_known = pursue(xs, ys, shape, fwhm, known, forbidden, noise)
                    numbers = [j for j, k in enumerate(known) if xs[0] <= k.x0 <= xs[-1]]
                    for j, line in enumerate(fitted.values.reshape(-1, n_params) if fitted else ()):
                        rows.append((key, grp, i, numbers[j] if j < n_known else None, *line[:3]))
            out = pd.DataFrame(rows, columns=["key", "grp", "interval", "known", "a", "x0", "dx"])
            yield out.astype({"known": "Int32"})

    return spread(spectra.select("key", "grp", "x", "y").where("size(y) > 0")).mapInPandas(run, "key long, grp int, interval int, known int, a double, x0 double, dx double")


# -- repeated clustering


def first_clusters(a: Sequence[float], b: Sequence[float], reach: float) -> list[list[float]]:
    """Each line of the first spectrum, and those of the second that are within reach of one; the others start clusters of their own."""
    clusters = [[v] for v in a]
    for v in b:
        d = [abs(np.mean(c) - v) for c in clusters]
        if d and min(d) <= reach:
            clusters[int(np.argmin(d))].append(v)
        else:
            clusters.append([v])
    return clusters


def gathered(sums: list[float], weights: list[float], places: np.ndarray, counts: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, weights) after the counted places, in their order, joined the nearest mean within reach or started a cluster."""
    sums, weights = list(sums), list(weights)
    squares = [s * s / w for s, w in zip(sums, weights)]
    for v, n in zip(places, counts):
        means = np.array(sums) / np.array(weights) if sums else np.zeros(0)
        d = np.abs(means - v)
        k = int(d.argmin()) if len(d) and d.min() <= reach else len(sums)
        if k == len(sums):
            sums.append(0.0)
            weights.append(0.0)
            squares.append(0.0)
        sums[k] += v * n
        weights[k] += n
        squares[k] += v * v * n
    s, w, q = np.array(sums), np.array(weights), np.array(squares)
    return s / w, np.sqrt(np.maximum(q / w - (s / w) ** 2, 0)), w


def middle_centres(runs: Sequence[np.ndarray]) -> np.ndarray:
    """Of several clusterings, those of the most frequent number (the least of equals): the median of each centre."""
    sizes = np.array([len(r) for r in runs])
    wanted = int(np.bincount(sizes).argmax())
    return np.median(np.stack([np.sort(r) for r in runs if len(r) == wanted]), axis=0)


def clustered(lines: DataFrame, hwhm: float, repeats: int = REPEATS, seed: int = 0, bins: int = BINS) -> DataFrame:
    """interval, line, x0, sd, n: common line places of each interval, from the lines (key, interval, x0) of many spectra.

    Lines within half a half width and one of a cluster's mean belong to it.  The lines are counted by places of
    a bins-th of that reach first, so tasks hold places, not spectra.  Each seeded pass
    starts from the lines of two spectra, chosen by a hash, and takes the places in a seeded order; one task
    makes one pass of one interval.  The passes' most frequent number of clusters and the medians of their
    centres then start a last pass over all places.  An interval without lines has no row.
    """
    reach = hwhm / 2 + 1
    own = lines.where(F.col("x0").isNotNull()).groupBy("interval", "key").agg(F.array_sort(F.collect_list("x0")).alias("x0s"))
    drawn = lambda s: F.min(F.struct(F.xxhash64("key", F.lit(seed), F.lit(s)).alias("h"), F.col("x0s").alias("x0s")))["x0s"]
    starts = own.groupBy("interval").agg(F.array(*(F.struct(drawn(2 * s).alias("a"), drawn(2 * s + 1).alias("b")) for s in range(repeats))).alias("starts"))
    starts = starts.select("interval", F.posexplode("starts").alias("pass", "start")).select("interval", "pass", "start.a", "start.b")
    places = own.select("interval", F.explode("x0s").alias("x0")).groupBy("interval", F.floor(F.col("x0") * bins / reach).alias("at")).agg(F.count("*").alias("n"), F.avg("x0").alias("x0"))
    dealt = places.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def one(key: tuple, own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        interval, number = int(key[0]), int(key[1])
        own = own.sort_values("at")
        order = np.random.default_rng([seed, interval, number]).permutation(len(own))
        clusters = first_clusters(list(start["a"].iloc[0]), list(start["b"].iloc[0]), reach)
        centres, _, _ = gathered([sum(c) for c in clusters], [float(len(c)) for c in clusters], own["x0"].to_numpy()[order], own["n"].to_numpy()[order], reach)
        return pd.DataFrame({"interval": [interval], "centres": [np.sort(centres)]})

    passes = dealt.groupBy("interval", "pass").cogroup(starts.groupBy("interval", "pass")).applyInPandas(one, "interval int, centres array<double>")

    def last(key: tuple, own: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        centres = middle_centres([np.asarray(c, float) for c in runs["centres"]])
        own = own.sort_values("at")
        means, sd, n = gathered([float(c) for c in centres], [1.0] * len(centres), own["x0"].to_numpy(), own["n"].to_numpy(), reach)
        order = np.argsort(means)
        return pd.DataFrame({"interval": int(key[0]), "line": np.arange(len(order)), "x0": means[order], "sd": sd[order], "n": n[order]})

    return places.groupBy("interval").cogroup(passes.groupBy("interval")).applyInPandas(last, "interval int, line int, x0 double, sd double, n double")


# -- scopes


def average_spectrum(spectra: DataFrame, by_group: bool) -> DataFrame:
    """key, grp, x, y of the mean of all spectra (group 0), or of each group's."""
    mean = aggregates.group_average(to_points(spectra), by=("grp",) if by_group else ())
    grp = F.col("grp") if by_group else F.lit(0)
    return to_spectra(mean.select(grp.cast("long").alias("key"), grp.cast("int").alias("grp"), "i", "x", "y"))


def template(spectra: DataFrame, scope: str, shape: str = "Gaussian", fwhm: float = 40.0, borders: Sequence[float] = (), hwhm: float | None = None, known: Sequence[Known] = (), forbidden: Sequence[tuple[float, float]] = (), noise: float | None = None, seed: int = 0) -> DataFrame:
    """The lines of a template (TEMPLATE), one row a line: numbered along the axis, with the bounds (low, high) of their places.

    'Average': the lines of the mean of all spectra. 'Average groups' and 'All': the clustered lines
    of the groups' means or of every spectrum, fitted to the mean of all spectra within their clusters' deviation.
    """
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope}; there are {', '.join(SCOPES)}")
    spark, whole = spectra.sparkSession, average_spectrum(spectra, by_group=False)
    if scope == "Average":
        found = guess(whole, borders, shape, fwhm, known, forbidden, noise)
        rows = found.select("interval", "a", "x0", "dx", (F.col("x0") - fwhm / 4).alias("low"), (F.col("x0") + fwhm / 4).alias("high"), F.lit(0.0).alias("sd"))
    else:
        each = guess(average_spectrum(spectra, by_group=True) if scope == "Average groups" else spectra, borders, shape, fwhm, known, forbidden, noise)
        centres = bounded(clustered(each, hwhm or fwhm / 2, seed=seed)).collect()
        rows = _refitted(spark, whole, centres, shape, fwhm)
    order = F.row_number().over(Window.orderBy("interval", "x0")) - 1  # of a template's lines, which bounded() counts
    return bounded(rows).select("interval", order.cast("int").alias("line"), labels.legend(F.col("x0")).alias("legend"), "a", "x0", "dx", "low", "high", "sd")


def bounded(rows: DataFrame) -> DataFrame:
    """rows, if they are no more than a template may have."""
    n = rows.limit(TEMPLATE_ROWS + 1).count()
    if n > TEMPLATE_ROWS:
        raise ValueError(f"a template has {TEMPLATE_ROWS} lines at most")
    return rows


def _refitted(spark: SparkSession, whole: DataFrame, centres: Sequence, shape: str, fwhm: float) -> DataFrame:
    """The clusters' lines fitted to the average spectrum, interval by interval."""
    width = len(peaks.names(shape))
    by = {}
    for r in centres:
        by.setdefault(r["interval"], []).append((r["x0"], r["sd"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.asarray(x, float), np.asarray(y, float)
                for interval, lines in by.items():
                    bounds = []
                    for x0, sd in lines:
                        near = y[np.abs(x - x0) <= fwhm]
                        top = max(float(near.max(initial=0.0)), 1e-9)
                        start, low, high = peaks.line_bounds(shape, x0, top / 2, fwhm, top)
                        low[1], high[1] = x0 - max(sd, 1.0), x0 + max(sd, 1.0)
                        bounds.append(([start[0], x0, *start[2:]], low, high))
                    inside = (x >= lines[0][0] - fwhm) & (x <= lines[-1][0] + fwhm)
                    s, low, high = (np.concatenate([p[j] for p in bounds]) for j in range(3))
                    p = peaks.fit(x[inside], y[inside], [shape] * len(lines), s, low, high).values.reshape(-1, width) if inside.sum() > 3 else np.array([p[0] for p in bounds])
                    out += [(interval, *line[:3], lo[1], hi[1], sd) for line, (_, lo, hi), (_, sd) in zip(p, bounds, lines)]
            yield pd.DataFrame(out, columns=["interval", "a", "x0", "dx", "low", "high", "sd"])

    return whole.select("x", "y").mapInPandas(run, "interval int, a double, x0 double, dx double, low double, high double, sd double")


def fit_template(spectra: DataFrame, lines: DataFrame, shape: str = "Gaussian", fwhm: float = 40.0) -> DataFrame:
    """key, grp, line, legend, a, x0, dx, r2: the template's lines fitted to every spectrum, interval by interval.

    The template is counted and broadcast as one row. Lines outside a spectrum's axis have no row; a failed fit gives none.
    """
    one = bounded(lines).agg(F.array_sort(F.collect_list(F.struct("interval", "line", "legend", "x0", "low", "high"))).alias("lines"))
    width = len(peaks.names(shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, grp, x, y, lines in zip(b["key"], b["grp"], b["x"], b["y"], b["lines"], strict=True):
                x, y = np.asarray(x, float), np.asarray(y, float)
                for interval in sorted({r["interval"] for r in lines}):
                    own = [r for r in lines if r["interval"] == interval and x[0] <= r["x0"] <= x[-1]]
                    if not own:
                        continue
                    inside = (x >= own[0]["x0"] - fwhm) & (x <= own[-1]["x0"] + fwhm)
                    bounds = []
                    for r in own:
                        top = max(float(y[np.abs(x - r["x0"]) <= fwhm].max(initial=0.0)), 1e-9)
                        start, low, high = peaks.line_bounds(shape, r["x0"], top / 2, fwhm, top)
                        low[1], high[1], start[1] = r["low"], r["high"], r["x0"]
                        bounds.append((start, low, high))
                    s, low, high = (np.concatenate([p[j] for p in bounds]) for j in range(3))
                    try:
                        fitted = peaks.fit(x[inside], y[inside], [shape] * len(own), s, low, high)
                    except (ValueError, np.linalg.LinAlgError):
                        continue
                    rows += [(key, grp, r["line"], r["legend"], *line[:3], fitted.r2) for r, line in zip(own, fitted.values.reshape(-1, width))]
            yield pd.DataFrame(rows, columns=["key", "grp", "line", "legend", "a", "x0", "dx", "r2"])

    joined = spectra.select("key", "grp", "x", "y").where("size(y) > 0").crossJoin(F.broadcast(one))
    return spread(joined).mapInPandas(run, "key long, grp int, line int, legend string, a double, x0 double, dx double, r2 double")
