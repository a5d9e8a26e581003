"""Averages and summaries across spectra, in the long layout; partial sums are made before each shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.relational import dimension, ranged
from lumenframe.scratch import checkpointed


def group_average(points: DataFrame, method: str = "Mean", by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Mean or exact median of each place, by group (or overall, without `by`)."""
    of = F.avg("y") if method == "Mean" else F.percentile("y", 0.5)
    return points.groupBy(*by, "i").agg(F.min("x").alias("x"), of.alias("y"))


def error_band(points: DataFrame, kind: str, level: float = 95.0) -> DataFrame:
    """Mean and error bar of each place: sd or se times level, or the percentile interval pi."""
    out = points.groupBy("grp", "i").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.count("y").alias("n"), F.percentile("y", (50 - level / 2) / 100).alias("p_low"), F.percentile("y", (50 + level / 2) / 100).alias("p_high"))
    if kind == "pi":
        return out.select("grp", "i", "mean", F.col("p_low").alias("low"), F.col("p_high").alias("high"))
    width = F.col("sd") * level if kind == "sd" else F.col("sd") / F.sqrt("n") * level
    return out.select("grp", "i", "mean", (F.col("mean") - width).alias("low"), (F.col("mean") + width).alias("high"))


def bootstrap_band(points: DataFrame, level: float = 95.0, n_boot: int = 100, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean over seeded Poisson resamples: each row counts 0, 1, 2 ... times in each."""
    u = F.pmod(F.xxhash64("key", "i", "b", F.lit(seed)), F.lit(1_000_003)).cast("double") / 1_000_003
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)), F.lit(0))
    drawn = points.select("key", "grp", "i", "y", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b")).withColumn("w", weight)
    means = drawn.groupBy("grp", "i", "b").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    return means.groupBy("grp", "i").agg(F.percentile("m", (50 - level / 2) / 100).alias("low"), F.percentile("m", (50 + level / 2) / 100).alias("high"))


def axis_ranges(spectra: DataFrame) -> DataFrame:
    """How many spectra have each axis range."""
    return spectra.groupBy(F.element_at("x", 1).alias("first_x"), F.element_at("x", -1).alias("last_x")).agg(F.count("*").alias("n"))


def common_range(spectra: DataFrame) -> DataFrame:
    return spectra.agg(F.max(F.element_at("x", 1)).alias("first_x"), F.min(F.element_at("x", -1)).alias("last_x"))


def quantiles(long: DataFrame, column: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The exact quantile of a column at each named share, interpolated between neighbours, by group; groups without values have no row.

    Two levels: values are counted by range first, and only the ranges that hold a wanted rank are
    looked into, so no task holds a group's values. Null values take no part, NaN is the greatest.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    cut = ranged(long.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(column).cast("double").alias("v")), "v")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.groupBy(*keys, "__range").agg(F.count("*").alias("n"))
    counted = counted.select(*keys, "__range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    place = {name: (F.col("total") - 1) * share for name, share in shares.items()}  # from 0, between two ranks
    ranks = {name: (F.floor(p), F.ceil(p)) for name, p in place.items()}
    holds = lambda rank: (rank >= F.col("first")) & (rank < F.col("first") + F.col("n"))
    wanted = checkpointed(counted.where(reduce(Column.__or__, (holds(r) for pair in ranks.values() for r in pair))).drop("n"))
    near = cut.alias("d").join(dimension(wanted).alias("w"), [F.col(f"d.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*keys, "__range")]).select("d.*", "first", "total")
    values = near.groupBy(*keys, "__range", "first", "total", "v").agg(F.count("*").alias("n"))
    inside = Window.partitionBy(*keys, "__range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("first", F.col("first") + F.sum("n").over(inside) - F.col("n"))
    ends = [F.max(F.when(holds(r), F.col("v"))).alias(f"__{side}_{name}") for name, pair in ranks.items() for side, r in zip(("low", "high"), pair)]
    found = ranked.groupBy(*keys, "total").agg(*ends)
    low, high = (lambda name: F.col(f"__low_{name}")), (lambda name: F.col(f"__high_{name}"))
    between = lambda name, p: F.when(low(name) == high(name), low(name)).otherwise((F.ceil(p) - p) * low(name) + (p - F.floor(p)) * high(name))
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), *(between(name, p).alias(name) for name, p in place.items()))


def describe(long: DataFrame, *by: str) -> DataFrame:
    """count, mean, std, min, exact quartiles, max of column `value`."""
    moments = long.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    joined = moments.alias("m").join(quartiles.alias("q"), same or F.lit(True), "left")
    return joined.select(*(F.col(f"m.{c}") for c in by), "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def curve_sum(curves: DataFrame) -> DataFrame:
    """Sum of the visible curves of each spectrum."""
    return curves.where("visible").groupBy("key", "i").agg(F.sum("y").alias("y"))


def fit_averages(fits: DataFrame) -> DataFrame:
    """Fit statistics by spectrum and over all (key null), without failed fits."""
    good = fits.where((F.col("chisqr") > 1e-250) & (F.col("bic") > float("-inf")))
    return good.rollup("key").agg(*(F.avg(c).alias(c) for c in ("chisqr", "redchi", "aic", "bic", "r2")))


def common_line_count(counts: DataFrame, *by: str) -> DataFrame:
    """The most frequent number of lines (the least of equally frequent ones)."""
    n = counts.groupBy(*by, "n_lines").agg(F.count("*").alias("times"))
    return n.groupBy(*by).agg(F.min_by("n_lines", F.struct(-F.col("times"), F.col("n_lines"))).alias("n_lines"))


def cluster_centres(values: DataFrame, *by: str) -> DataFrame:
    """Median and deviation (divisor n) of each cluster."""
    return values.groupBy(*by).agg(F.percentile("value", 0.5).alias("centre"), F.stddev_pop("value").alias("spread"), F.count("*").alias("n"))
