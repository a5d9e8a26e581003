"""Peak decomposition: guessing lines, common templates, batch fits, curves and datasets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import labels
from lumenframe.kernels import many_fits, optimizers, peaks
from lumenframe.plans.pipeline import dealt, pieces, spread

#: Places counted as one for a template, as parts of the half width that clusters have.
BINS = 50
PARAMS = "key long, grp int, line int, param string, value double, stderr double, min_value double, max_value double"


def guess_lines(spectra: DataFrame, borders: Sequence[float] = (), shape: str = "Gaussian", fwhm: float | None = None) -> DataFrame:
    """key, grp, interval, x0 of the lines found in each interval of each spectrum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, grp, x, y in zip(b["key"], b["grp"], b["x"], b["y"], strict=True):
                x, y = np.asarray(x, float), np.asarray(y, float)
                for k, part in enumerate(peaks.split_by_borders(x, list(borders)) if len(x) else []):
                    found = peaks.guess(x[part], y[part], shape, fwhm)[0] if part.stop - part.start > 4 else []
                    rows += [(key, grp, k, v) for v in found]
            yield pd.DataFrame(rows, columns=["key", "grp", "interval", "x0"])

    return spread(spectra.select("key", "grp", "x", "y").where("size(y) > 0")).mapInPandas(run, "key long, grp int, interval int, x0 double")


def template(guessed: DataFrame, hwhm: float, seed: int = 0) -> DataFrame:
    """Common line places of each interval, numbered along the axis, from the lines of all spectra.

    Lines are counted by places of hwhm / BINS width, and spectra by their number of lines, before an
    interval's clusters are made; so the task of an interval holds its places, not its spectra.
    A centre is off the median of its lines by one such width at most.
    """
    own = guessed.groupBy("interval", "key").agg(F.collect_list("x0").alias("x0s"))
    lines = F.size("x0s").cast("long")
    marks = F.transform("x0s", lambda v: F.struct(F.lit(False).alias("is_number"), F.floor(v * BINS / hwhm).alias("at"), v.alias("x0")))
    number = F.array(F.struct(F.lit(True).alias("is_number"), lines.alias("at"), lines.cast("double").alias("x0")))
    counts = own.select("interval", F.explode(F.concat(number, marks)).alias("m")).groupBy("interval", "m.is_number", "m.at").agg(F.count("*").alias("n"), F.avg("m.x0").alias("x0"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        k = int(g["interval"].iloc[0])
        numbers, places = (g[g["is_number"] == is_number].sort_values("at") for is_number in (True, False))
        wanted = int(numbers["at"].iloc[int(numbers["n"].argmax())])
        return pd.DataFrame({"interval": k, "x0": peaks.cluster_counts(places["x0"].to_numpy().round(6), places["n"].to_numpy(), hwhm, wanted, seed + k)})

    places = counts.groupBy("interval").applyInPandas(run, "interval int, x0 double")
    return places.withColumn("legend", labels.legend(F.col("x0")))


def fit_batch(spectra: DataFrame, x0: Sequence[float], shape: str = "Gaussian", fwhm: float = 40.0, borders: Sequence[float] = (), method: str = "least_squares") -> DataFrame:
    """Parameters of the template's lines fitted to every spectrum, interval by interval."""
    return fits(spectra, x0, shape, fwhm, borders, method).select("key", "grp", F.explode("params").alias("p")).select("key", "grp", "p.*")


def fits(spectra: DataFrame, x0: Sequence[float], shape: str = "Gaussian", fwhm: float = 40.0, borders: Sequence[float] = (), method: str = "least_squares") -> DataFrame:
    """One row a spectrum and interval: params, statistics, curve and its three-sigma band. Failed fits give no row.

    method: a name of optimizers.METHODS.
    """
    names = peaks.names(shape)
    if method not in optimizers.METHODS:
        raise ValueError(f"no fit method {method}; there are {', '.join(optimizers.METHODS)}")
    many = method in ("least_squares", "leastsq") or method in many_fits.METHODS

    def fitted(xs, ys, lines, start, low, high):
        """A fit of each row, None where it failed."""
        try:
            if many and np.isfinite(ys).all():
                return peaks.fit_many(xs, ys, [shape] * lines, start, low, high, partial(many_fits.minimise, method))
            if len(ys) == 1:
                solver = peaks.least_squares if method in ("least_squares", "leastsq") else partial(optimizers.minimise, method)
                return [peaks.fit(xs, ys[0], [shape] * lines, start[0], low[0], high[0], solver=solver)]
        except (ValueError, np.linalg.LinAlgError):
            if len(ys) == 1:
                return [None]
        return [r for i in range(len(ys)) for r in fitted(xs, ys[i : i + 1], lines, start[i : i + 1], low[i : i + 1], high[i : i + 1])]

    def rows_of(keys, x, y):
        """Fits of spectra of one axis."""
        for k, part in enumerate(peaks.split_by_borders(x, list(borders))):
            xs, ys = x[part], np.ascontiguousarray(y[:, part])
            lines = [(i, v) for i, v in enumerate(x0) if xs[0] <= v <= xs[-1]]
            if not lines or len(xs) < 4:
                continue
            tops = [ys[:, np.abs(xs - v) <= fwhm].max(axis=1, initial=0.0) for _, v in lines]
            bounds = np.array([[np.concatenate(e) for e in zip(*(peaks.line_bounds(shape, v, max(float(t[r]) / 2, 1e-9), fwhm, max(float(t[r]), 1e-9)) for (_, v), t in zip(lines, tops, strict=True)), strict=True)] for r in range(len(ys))])
            start, low, high = bounds[:, 0], bounds[:, 1], bounds[:, 2]
            for (key, grp), r, lo, hi, own in zip(keys, fitted(xs, ys, len(lines), start, low, high), low, high, ys, strict=True):
                if r is None:
                    continue
                top, bottom = peaks.band(r)
                params = [{"line": i, "param": n, "value": round(float(r.values[j * len(names) + m]), 5), "stderr": float(r.errors[j * len(names) + m]), "min_value": float(lo[j * len(names) + m]), "max_value": float(hi[j * len(names) + m])} for j, (i, _) in enumerate(lines) for m, n in enumerate(names)]
                yield (key, grp, k, params, r.chisqr, r.redchi, r.aic, r.bic, r.r2, xs, own, r.curve, top, bottom)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            alike: dict[bytes, list[int]] = {}
            for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
                if len(x):
                    alike.setdefault(np.asarray(x, float).tobytes(), []).append(i)
            keys, ys = list(zip(b["key"], b["grp"], strict=True)), list(b["y"])
            rows = [row for axis, own in alike.items() for row in rows_of([keys[i] for i in own], np.frombuffer(axis), np.array([ys[i] for i in own], float))]
            yield pd.DataFrame(rows, columns=["key", "grp", "interval", "params", "chisqr", "redchi", "aic", "bic", "r2", "x", "y", "curve", "top", "bottom"])

    item = "struct<line:int,param:string,value:double,stderr:double,min_value:double,max_value:double>"
    return dealt(spectra.select("key", "grp", "x", "y").where("size(y) > 0")).mapInPandas(run, f"key long, grp int, interval int, params array<{item}>, chisqr double, redchi double, aic double, bic double, r2 double, x array<double>, y array<double>, curve array<double>, top array<double>, bottom array<double>")


def dataset(params: DataFrame, value: str = "a") -> DataFrame:
    """key, grp, features: one parameter of every line, in the order of lines (an array, so any number of lines)."""
    rows = params.where(F.col("param") == value).groupBy("key", "grp").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("v"))
    return rows.select("key", "grp", F.col("v.value").alias("features"))


def despiked(spectra: DataFrame, laser: float, fwhm: float, maxima: int = 3) -> DataFrame:
    """Spectra without spikes, and the places of the spikes (null if none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [peaks.despike(np.asarray(x, float), np.asarray(y, float), laser, fwhm, maxima) for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.assign(y=[d[0] for d in done], peaks=[d[1] or None for d in done])

    return spread(spectra.select("key", "grp", "x", "y").where("size(y) > 0")).mapInPandas(run, "key long, grp int, x array<double>, y array<double>, peaks array<double>")
