"""Preprocessing pipelines over spectra, planned as few passes.

A pipeline is an ordered list of steps.  Steps of tier A are array expressions, steps of
tier B NumPy kernels.  The planner puts filters first (nothing passes a Python node by
itself), keeps only the columns a kernel needs, and fuses runs of kernels into one
Arrow pass, so a spectrum crosses to Python once however many kernels follow each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.kernels import baseline, peaks, smooth
from lumenframe.operators.aggregates import group_average
from lumenframe.schema import SPECTRA, to_points

#: Default order of the stages that a pipeline may enable.
ORDER = ("interpolate", "despike", "convert", "cut", "baseline", "smooth", "normalize", "trim", "average")


#: Bytes under which Spark doesn't split files further, whatever the number of cores.
SPLIT_BYTES = 4 << 20
#: Expected bytes of a task of kernels, and the number of tasks beyond which they grow instead.
DEALT_BYTES, MOST_TASKS = 512 << 10, 10_000
#: Spark expects some 2^63 bytes of rows that come from the driver.
UNTOLD_BYTES = 1 << 50
#: Points of the spectra that a kernel's task holds at a time.
PIECE_POINTS = 1 << 17
#: Points that a baseline of many spectra steps over at a time.
MANY_POINTS = 1 << 15


@dataclass(frozen=True)
class Step:
    kind: str
    name: str = ""
    params: dict = field(default_factory=dict)


def seed_of(key, salt: int = 0) -> int:
    """The same for a spectrum wherever it lies."""
    return crc32(f"{key}:{salt}".encode())


def _kernel(step: Step) -> Callable:
    """(key, x, y) -> y."""
    p = step.params
    if step.kind == "baseline":
        f = baseline.METHODS[step.name]
        return lambda key, x, y: y - f(x, y, **p)
    if step.kind == "smooth":
        f = smooth.SMOOTHERS[step.name]
        if step.name in smooth.SEEDED:
            return lambda key, x, y: f(x, y, **p, seed=seed_of(key))
        return lambda key, x, y: f(x, y, **p)
    if step.kind == "normalize":
        return lambda key, x, y: smooth.emsc(x, y, np.asarray(p["reference"]), p.get("n_pca", 8))
    if step.kind == "despike":
        return lambda key, x, y: peaks.despike(x, y, p["laser"], p["fwhm"], p.get("maxima", 3))[0]
    raise ValueError(f"no kernel for {step}")


def _kernel_of_many(step: Step) -> Callable:
    """(keys, x of each, y of each) -> y of each; spectra of one length at once where the kernel can."""
    if step.kind == "baseline" and step.name in baseline.MANY:
        return lambda keys, x, y: [v - z for v, z in zip(y, baselines(step.name, x, y, step.params), strict=True)]
    if step.kind == "smooth" and step.name in smooth.MANY_ON_AXIS:
        return lambda keys, x, y: on_axes(smooth.SMOOTHERS[step.name], smooth.MANY_ON_AXIS[step.name], x, y, step.params)
    if step.kind != "smooth" or step.name not in smooth.MANY:
        f = _kernel(step)
        return lambda keys, x, y: [f(*own) for own in zip(keys, x, y, strict=True)]
    many, copies = smooth.MANY[step.name]
    copies = step.params.get("trials", copies)

    def run(keys: list, x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
        out, alike = list(y), {}
        for i, v in enumerate(y):
            alike.setdefault(len(v), []).append(i)
        for length, own in alike.items():
            few = max(1, PIECE_POINTS // (length * copies))
            for part in (own[k : k + few] for k in range(0, len(own), few)):
                for i, v in zip(part, many(np.array([y[i] for i in part]), [seed_of(keys[i]) for i in part], **step.params), strict=True):
                    out[i] = v
        return out

    return run


def is_kernel(step: Step) -> bool:
    return step.kind in ("baseline", "despike") and step.name != "Linear" or step.name in smooth.SMOOTHERS or step.name == "EMSC"


def spread(df: DataFrame) -> DataFrame:
    """Dealt out evenly if its plan expects no more bytes than a split a core (few small files); otherwise as it is. Nothing is run to tell."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if expected <= cores * SPLIT_BYTES else df


def dealt(df: DataFrame) -> DataFrame:
    """For kernels, whose time by far exceeds that of reading: dealt out evenly into tasks of DEALT_BYTES of its plan's expected bytes, at least one a core. Nothing is run to tell.

    As it is where its bytes can't be told.
    """
    if df.isStreaming:
        return df
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected >= UNTOLD_BYTES:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-expected // DEALT_BYTES))))


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches in frames of PIECE_POINTS points of y at most (one row at least), so what a task makes of them doesn't grow with its rows."""
    for b in batches:
        begin, points = 0, np.cumsum([0 if y is None else len(y) for y in b["y"]])
        while begin < len(b):
            end = max(begin + 1, int(np.searchsorted(points, (points[begin - 1] if begin else 0) + PIECE_POINTS, side="right")))
            yield b.iloc[begin:end]
            begin = end


def run_kernels(spectra: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Consecutive kernels in one pass. Empty and null spectra stay as they are."""
    kernels = [_kernel_of_many(s) for s in steps]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            whole = [i for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)) if x is not None and y is not None and len(y)]
            keys, out = [b["key"].iloc[i] for i in whole], list(b["y"])
            xs, ys = ([np.asarray(b[n].iloc[i], float) for i in whole] for n in ("x", "y"))
            for k in kernels:
                ys = k(keys, xs, ys)
            for i, y in zip(whole, ys, strict=True):
                out[i] = y
            yield b.assign(y=out)

    return dealt(spectra.select("key", "grp", "x", "y")).mapInPandas(run, SPECTRA)


def _expression(step: Step, df: DataFrame) -> DataFrame:
    x, y, p = F.col("x"), F.col("y"), step.params
    if step.kind in ("cut", "trim"):
        s, e = A.nearest_stepping_back(x, p["start"]), A.nearest_stepping_back(x, p["end"])
        whole = (F.round(F.get(x, F.lit(0)), 5) == round(p["start"], 5)) & (F.round(F.element_at(x, -1), 5) == round(p["end"], 5))  # nothing to cut
        return df.select("key", "grp", *(F.when(whole, v).otherwise(A.cut(v, s, e)).alias(n) for n, v in (("x", x), ("y", y))))
    if step.kind == "interpolate":
        axis = F.array(*map(F.lit, map(float, p["axis"])))
        same = x == axis
        # new names first: within a lambda, a column of this select's would be read in place of the old x
        new = df.select("key", "grp", axis.alias("new_x"), F.when(same, y).otherwise(A.interpolate(x, y, p["axis"])).alias("new_y"))
        return new.select("key", "grp", F.col("new_x").alias("x"), F.col("new_y").alias("y"))
    if step.kind == "convert":
        laser = p["laser"]
        edge = A.nearest(x, laser + 5)
        head = F.slice(y, F.lit(1), F.greatest(edge, F.lit(1)))
        base = F.get(x, A.plateau(head))
        return df.select("key", "grp", A.to_wavenumber(x, laser, base).alias("x"), "y")
    if step.kind == "normalize":
        return df.withColumn("y", A.NORMALIZERS[step.name](y))
    if step.kind == "baseline":
        return df.withColumn("y", A.detrend(y))
    windows: dict[str, Callable[[], Column]] = {
        "Savitzky-Golay filter": lambda: A.savgol(y, p["window"], p["order"]), "Flat window": lambda: A.flat_window(y, p["window"]),
        "Median filter": lambda: A.median_filter(y, p["window"]), "Wiener filter": lambda: A.wiener(y, p["window"]),
    } | {k: (lambda k=k: A.window_smooth(y, k, p["window"], p.get("beta", 8.0))) for k in A.WINDOWS}
    return df.withColumn("y", windows[step.name]())


def plan(steps: Sequence[Step]) -> list[tuple[bool, list[Step]]]:
    """(is it a kernel pass, its steps): neighbours of one tier together."""
    return [(k, list(g)) for k, g in groupby((s for s in steps if s.kind != "average"), is_kernel)]


def apply(spectra: DataFrame, steps: Sequence[Step], where: Column | None = None) -> DataFrame:
    """The pipeline's result; with an average step, group averages in the long layout."""
    df = spectra.select("key", "grp", "x", "y")
    if where is not None:
        df = df.where(where)
    for kernel, group in plan(steps):
        if kernel:
            df = run_kernels(df, group)
        else:
            for s in group:
                df = _expression(s, df)
    average = [s for s in steps if s.kind == "average"]
    return group_average(to_points(df), average[0].name or "Mean") if average else df


def with_baselines(spectra: DataFrame, name: str, axis: Sequence[float] | None = None, **params) -> DataFrame:
    """key, grp, x, y, baseline, corrected; with an axis, of the spectra drawn on it (in the same pass, so the longer rows don't cross to Python)."""
    places = None if axis is None else np.asarray(axis, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            b = b[b["x"].notna() & b["y"].notna()]  # not by where(): a filter would be pushed down, and the steps before it made twice
            if places is None:
                yield _with_baselines(name, b, params)
                continue
            few = max(1, PIECE_POINTS // len(places))
            for k in range(0, len(b), few):
                part = b.iloc[k : k + few]
                drawn = [np.interp(places, x, y) if len(y) else np.zeros(0) for x, y in zip(part["x"], part["y"], strict=True)]
                yield _with_baselines(name, part.assign(x=[places if len(y) else y for y in drawn], y=drawn), params)

    return dealt(spectra.select("key", "grp", "x", "y")).mapInPandas(run, SPECTRA + ", baseline array<double>, corrected array<double>")


def baselines(name: str, x: Sequence[np.ndarray], y: Sequence[np.ndarray], params: dict) -> list[np.ndarray]:
    """A baseline of each spectrum."""
    return on_axes(baseline.METHODS[name], baseline.MANY.get(name), x, y, params)


def on_axes(one: Callable, many: Callable | None, x: Sequence[np.ndarray], y: Sequence[np.ndarray], params: dict) -> list[np.ndarray]:
    """one of each spectrum, or many of those of one axis at once. Spectra with values that aren't finite go alone."""
    out, alike = [np.zeros(0)] * len(y), {}
    for i, (u, v) in enumerate(zip(x, y, strict=True)):
        if many and len(v) and np.isfinite(v).all() and np.isfinite(u).all():
            alike.setdefault(u.tobytes(), []).append(i)
        elif len(v):
            out[i] = one(u, v, **params)
    for own in alike.values():
        few = max(1, MANY_POINTS // len(y[own[0]]))
        for part in (own[k : k + few] for k in range(0, len(own), few)):
            for i, z in zip(part, many(x[part[0]], np.array([y[i] for i in part]), **params), strict=True):
                out[i] = z
    return out


def _with_baselines(name: str, b: pd.DataFrame, params: dict) -> pd.DataFrame:
    z = baselines(name, [np.asarray(x, float) for x in b["x"]], [np.asarray(y, float) for y in b["y"]], params)
    return b.assign(baseline=z, corrected=[np.asarray(y) - v for y, v in zip(b["y"], z, strict=True)])
