"""Column expressions over the arrays of one spectrum: no shuffle, no Python.

y, x: array<double> columns.  Results are columns; positions count from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0.0)


def places(y: Column) -> Column:
    return F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>"))


def at(y: Column, i) -> Column:
    """The value at a place, null outside."""
    return F.get(y, i if isinstance(i, Column) else F.lit(i))


def total(y: Column) -> Column:
    return F.aggregate(y, zero(), lambda a, v: a + v)


def mean(y: Column) -> Column:
    return total(y) / F.size(y)


def moments(y: Column) -> Column:
    """(mean, standard deviation with divisor n)."""
    m = F.transform(F.array(mean(y)), lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(y, zero(), lambda a, v: a + (v - m) * (v - m)) / F.size(y)).alias("std")))
    return F.get(m, F.lit(0))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# -- normalizers (NRM)


def snv(y: Column) -> Column:
    return bound(moments(y), lambda m: F.transform(y, lambda v: (v - m["mean"]) / m["std"]))


def l2_norm(y: Column) -> Column:
    return bound(F.sqrt(F.aggregate(y, zero(), lambda a, v: a + v * v)), lambda n: F.transform(y, lambda v: v / n))


def unit_trapezoid(y: Column) -> Column:
    """Trapezoid area with unit spacing."""
    return total(y) - (at(y, 0) + F.element_at(y, -1)) / 2


def trapezoid_norm(y: Column) -> Column:
    return bound(unit_trapezoid(y), lambda n: F.transform(y, lambda v: v / n))


def max_norm(y: Column) -> Column:
    return bound(F.array_max(y), lambda n: F.transform(y, lambda v: v / n))


def min_max(y: Column) -> Column:
    ends = F.struct(F.array_min(y).alias("lo"), F.array_max(y).alias("hi"))
    return bound(ends, lambda e: F.transform(y, lambda v: (v - e["lo"]) / (e["hi"] - e["lo"])))


NORMALIZERS = {"SNV": snv, "Area": l2_norm, "Trapezoidal rule area": trapezoid_norm, "Max intensity": max_norm, "Min-max intensity": min_max}

# -- neighbours along the axis (WIN, MTH)


def diff(y: Column) -> Column:
    return F.transform(y, lambda v, i: F.when(i == 0, zero()).otherwise(v - F.get(y, i - 1)))


def gradient(y: Column) -> Column:
    """Central inside, one-sided at the ends, unit spacing."""
    last = F.size(y) - 1
    return F.transform(y, lambda v, i: F.when(i == 0, F.get(y, i + 1) - v).when(i == last, v - F.get(y, i - 1)).otherwise((F.get(y, i + 1) - F.get(y, i - 1)) / 2))


def derivative(x: Column, y: Column) -> Column:
    """dy/dx to the right neighbour; the last value repeats the one before."""
    last = F.size(y) - 1
    step = lambda i: (F.get(y, i + 1) - F.get(y, i)) / (F.get(x, i + 1) - F.get(x, i))
    return F.transform(y, lambda _, i: step(F.least(i, last - 1)))


def trapezoid(x: Column, y: Column) -> Column:
    return F.aggregate(places(y), zero(), lambda a, i: a + F.when(i == 0, zero()).otherwise((F.get(y, i) + F.get(y, i - 1)) / 2 * (F.get(x, i) - F.get(x, i - 1))))


def weighted(y: Column, weights: Sequence[float]) -> Column:
    """Sum of neighbours times weights, zero outside; the middle weight meets the place itself."""
    half = len(weights) // 2

    def one(_, i):
        out = zero()
        for k, w in enumerate(weights):
            j = i + (k - half)
            out = out + F.coalesce(F.when(j >= 0, F.get(y, j)), zero()) * float(w)
        return out

    return F.transform(y, one)


def flat_window(y: Column, length: int) -> Column:
    return weighted(y, [1 / length] * length)


#: Windows by name; kaiser also takes beta.
WINDOWS = {"hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman, "kaiser": np.kaiser}


def window_smooth(y: Column, kind: str, length: int, beta: float = 8.0) -> Column:
    """A symmetric odd window, its weights scaled to sum one."""
    w = WINDOWS[kind](length, beta) if kind == "kaiser" else WINDOWS[kind](length)
    return weighted(y, (w / w.sum()).tolist())


def moving_average(y: Column, half: int) -> Column:
    """Mean of the neighbours within half places; fewer at the ends."""
    n = F.size(y)
    part = lambda i: F.slice(y, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1)
    return F.transform(places(y), lambda i: mean(part(i)))


def _padded(y: Column, half: int) -> Column:
    pad = F.array_repeat(zero(), half)
    return F.concat(pad, y, pad)


def median_filter(y: Column, length: int) -> Column:
    """Running median of an odd length (even: one more), zero outside."""
    length += 1 - length % 2
    padded = _padded(y, length // 2)
    return bound(padded, lambda p: F.transform(places(y), lambda i: F.get(F.array_sort(F.slice(p, i + 1, length)), F.lit(length // 2))))


def wiener(y: Column, length: int) -> Column:
    """Wiener filter: local mean and variance over an odd length, zero outside; noise is the mean local variance."""
    half = length // 2

    def local(p: Column) -> Column:
        def one(i):
            part = F.slice(p, i + 1, length)
            m = total(part) / length
            return F.struct(m.alias("m"), (F.aggregate(part, zero(), lambda a, v: a + v * v) / length - m * m).alias("v"))

        return F.transform(places(y), one)

    stats = bound(_padded(y, half), local)

    def smooth(s: Column) -> Column:
        noise = F.aggregate(s, zero(), lambda a, v: a + v["v"]) / F.size(s)
        return bound(noise, lambda q: F.transform(s, lambda v, i: F.when(v["v"] < q, v["m"]).otherwise(v["m"] + (F.get(y, i) - v["m"]) * (1 - q / v["v"]))))

    return bound(stats, smooth)


def savgol_rows(length: int, order: int) -> np.ndarray:
    """Row k: weights that give the fitted polynomial's value at place k of a window."""
    t = np.arange(length) - length // 2
    v = np.vander(t, order + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def savgol(y: Column, length: int, order: int) -> Column:
    """Savitzky-Golay; the ends take the polynomials of the first and last whole window."""
    rows, half = savgol_rows(length, order), length // 2
    table = F.array(*[F.array(*[F.lit(float(w)) for w in r]) for r in rows])
    n = F.size(y)

    def one(i):
        start = F.least(F.greatest(i - half, F.lit(0)), n - length)
        part = F.slice(y, start + 1, length)
        return F.aggregate(F.zip_with(part, F.get(table, i - start), lambda v, w: v * w), zero(), lambda a, v: a + v)

    return F.transform(places(y), one)


def is_local_minimum(y: Column, order: int = 1) -> Column:
    """Places lower than all within `order` on both sides; ends never are."""
    n = F.size(y)

    def one(v, i):
        out = (i >= 1) & (i <= n - 2)
        for k in range(1, order + 1):
            left, right = F.get(y, F.greatest(i - k, F.lit(0))), F.get(y, F.least(i + k, n - 1))
            out = out & (v < left) & (v < right)
        return out

    return F.transform(y, one)


def minima(y: Column, order: int = 1) -> Column:
    flags = is_local_minimum(y, order)
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def dilate(mask: Column, width: int) -> Column:
    """True where any place within width - 1 is; both sides."""
    n = F.size(mask)
    reach = width - 1
    part = lambda i: F.slice(mask, F.greatest(i - reach, F.lit(0)) + 1, F.least(i + reach, n - 1) - F.greatest(i - reach, F.lit(0)) + 1)
    return F.transform(places(mask), lambda i: F.exists(part(i), lambda m: m))


def dilate_left(mask: Column, width: int) -> Column:
    """One-sided: a true place also marks the width - 1 places before it."""
    n = F.size(mask)
    return F.transform(places(mask), lambda i: F.exists(F.slice(mask, i + 1, F.least(F.lit(width), n - i)), lambda m: m))


def nearest(x: Column, value) -> Column:
    """The place of the value of x nearest to it; the lower of two as near."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    best = F.array_min(F.transform(x, lambda v, i: F.struct(F.abs(v - value).alias("d"), i.alias("i"))))
    return best["i"]


def nearest_stepping_back(x: Column, value) -> Column:
    """nearest(), one place lower if the nearest value is over 1 beyond the wanted one."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    i = nearest(x, value)
    return F.when((F.round(F.get(x, i) - value, 5) > 1) & (i > 0), i - 1).otherwise(i)


def cut(a: Column, first: Column, last: Column) -> Column:
    """Places first to last, both kept."""
    return F.slice(a, first + 1, last - first + 1)


def at_or_below(x: Column, value: Column) -> Column:
    """How many values of an ascending axis are at or below one, by bisection: the cost of a place grows with the logarithm of the axis."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(x) + 1)).cast("int"))
    whole = F.struct(F.lit(0).alias("low"), F.size(x).alias("high"))

    def half(a: Column, _) -> Column:
        mid = F.shiftright(a["low"] + a["high"], 1)
        right = F.coalesce(F.get(x, mid) <= value, F.lit(False))
        return F.struct(F.when(right, mid + 1).otherwise(a["low"]).alias("low"), F.when(right, a["high"]).otherwise(mid).alias("high"))

    return F.when(F.size(x) > 0, F.aggregate(steps, whole, half)["low"]).otherwise(F.lit(0))


def interpolate(x: Column, y: Column, axis: Sequence[float]) -> Column:
    """Linear on an ascending axis, clamped at the ends."""

    def between(v: Column, hi: Column) -> Column:
        x0, x1, y0, y1 = F.get(x, hi - 1), F.get(x, hi), F.get(y, hi - 1), F.get(y, hi)
        return y0 + (v - x0) * (y1 - y0) / (x1 - x0)

    def one(v: Column) -> Column:
        hi = F.greatest(F.least(at_or_below(x, v), F.size(x) - 1), F.lit(1))
        inside = bound(hi, lambda h: between(v, h))
        return F.when(v <= at(x, 0), at(y, 0)).when(v >= F.element_at(x, -1), F.element_at(y, -1)).otherwise(inside)

    return F.transform(F.array(*[F.lit(float(a)) for a in axis]), one)


def line_fit(y: Column) -> Column:
    """(slope, intercept) of y over its places."""
    n = F.size(y).cast("double")
    mid = (n - 1) / 2
    slope = F.aggregate(places(y), zero(), lambda a, i: a + (i - mid) * F.get(y, i)) / (n * (n * n - 1) / 12)
    return bound(slope, lambda s: F.struct(s.alias("slope"), (mean(y) - s * mid).alias("intercept")))


def detrend(y: Column) -> Column:
    return bound(line_fit(y), lambda f: F.transform(y, lambda v, i: v - (f["slope"] * i + f["intercept"])))


def to_wavenumber(x: Column, laser: float, base: Column) -> Column:
    """nm to 1/cm, the axis shifted so that the Rayleigh line at `base` lies on the laser."""
    return F.transform(x, lambda v: F.lit(1e7 / laser) - F.lit(1e7) / (v + laser - base))


def down_sample(y: Column, factor: int, how: str) -> Column:
    """Blocks of `factor` places: their first value, mean, or (max, min) after each other; the tail that fills no block goes."""
    blocks = F.transform(F.sequence(F.lit(1), F.floor(F.size(y) / factor).cast("int")), lambda b: F.slice(y, (b - 1) * factor + 1, factor))
    if how == "subsample":
        return F.transform(blocks, lambda b: F.get(b, F.lit(0)))
    if how == "mean":
        return F.transform(blocks, lambda b: mean(b))
    return F.flatten(F.transform(blocks, lambda b: F.array(F.array_max(b), F.array_min(b))))


def plateau(y: Column) -> Column:
    """Mean place (whole part) of the first run of the maximum."""

    def run(top: Column) -> Column:
        def step(acc, i):
            hit = F.get(y, i) == top
            first = F.when(acc["first"].isNull() & hit, i).otherwise(acc["first"])
            last = F.when(hit & (acc["last"].isNull() | (acc["last"] == i - 1)), i).otherwise(acc["last"])
            return F.struct(first.alias("first"), last.alias("last"))

        start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
        return F.aggregate(places(y), start, step, lambda a: F.floor((a["first"] + a["last"]) / 2).cast("int"))

    return bound(F.array_max(y), run)


def snr(y: Column) -> Column:
    """Maximum over the deviation from a Savitzky-Golay fit (9 places, order 3)."""
    rest = F.zip_with(y, savgol(y, 9, 3), lambda a, b: a - b)
    return F.array_max(y) / moments(rest)["std"]


def erode(y: Column, half: int) -> Column:
    return _frame(y, half, F.array_min)


def enlarge(y: Column, half: int) -> Column:
    return _frame(y, half, F.array_max)


def _frame(y: Column, half: int, of) -> Column:
    n = F.size(y)
    return F.transform(places(y), lambda i: of(F.slice(y, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1)))


def opening(y: Column, half: int) -> Column:
    """Top-hat's baseline: erosion, then dilation."""
    return bound(erode(y, half), lambda e: enlarge(e, half))


def deviation(y: Column) -> Column:
    return moments(y)["std"]


def fluorescence_start(x: Column, y: Column, factor: int = 1, from_x: float = 100.0) -> Column:
    """From the axis value nearest from_x: after the first gradient over the gradients' deviation, the place
    where a run of `factor` falling gradients is complete (its first place, for a factor of 1); null if none is."""
    falls = lambda g, i: F.forall(F.sequence(i - (factor - 1), i), lambda j: F.coalesce(F.get(g, j) < 0, F.lit(False)))

    # each value is bound before the lambda that runs over the places: a column named inside it would be made anew for every place
    def after(g: Column, steep: Column) -> Column:
        return F.array_min(F.filter(F.transform(g, lambda v, i: F.when((v < 0) & (i - (factor - 1) > steep) & falls(g, i), i)), lambda i: i.isNotNull()))

    def steepest(g: Column, e: Column) -> Column:
        return F.array_min(F.filter(F.transform(g, lambda v, i: F.when((i >= e["start"]) & (v > e["limit"]), i)), lambda i: i.isNotNull()))

    def found(g: Column) -> Column:
        ends = F.struct(nearest(x, from_x).alias("start"), deviation(g).alias("limit"))
        return bound(ends, lambda e: bound(steepest(g, e), lambda steep: after(g, steep)))

    return bound(gradient(y), found)


def moved_amplitude(x: Column, y: Column, low: Column, high: Column) -> Column:
    """The highest value whose place lies in [low, high]."""
    return F.array_max(F.transform(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] >= low) & (p["x"] <= high)), lambda p: p["y"]))
