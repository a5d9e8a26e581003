"""Column functions for views of a spectrum: mappings of axes, peak extents, densities."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A


def log_axis(v: Column) -> Column:
    """log10 of each value; null where it isn't finite."""
    return F.transform(v, lambda u: F.when((u > 0) & (u < float("inf")), F.log10(u)))


def phase_map(x: Column, y: Column) -> Column:
    """(value, dy/dx) of each point but the last, with the slope to the next point."""
    slopes = F.transform(F.sequence(F.lit(0), F.size(y) - 2), lambda i: F.struct(F.get(y, i).alias("value"), ((F.get(y, i + 1) - F.get(y, i)) / (F.get(x, i + 1) - F.get(x, i))).alias("slope")))
    return F.when(F.size(y) > 1, slopes).otherwise(F.array().cast("array<struct<value:double,slope:double>>"))


def nearest_left(x: Column, value: float) -> Column:
    """The place of the greatest value of an ascending axis at or below `value`; null if there is none."""
    return F.array_max(F.filter(A.places(x), lambda i: F.get(x, i) <= F.lit(float(value))))


def peak_extent(y: Column, top: Column) -> Column:
    """(left, right, left_quarter, right_quarter): the nearest places at which y is at most a half, or three quarters, of y at `top`; else the ends."""
    n = F.size(y)

    def side(share: float, left: bool) -> Column:
        low = F.filter(A.places(y), lambda i: ((i <= top) if left else (i >= top)) & (F.get(y, i) <= F.get(y, top) * share))
        return F.coalesce(F.array_max(low), F.lit(0)) if left else F.coalesce(F.array_min(low), n - 1)

    left, right = side(0.5, True), side(0.5, False)
    return F.struct(left.alias("left"), (right + (left == right).cast("int")).alias("right"), side(0.75, True).alias("left_quarter"), side(0.75, False).alias("right_quarter"))


def density(df: DataFrame, value: str, grid: Sequence[float], bandwidth: float = 0.5) -> DataFrame:
    """(at, density): Gaussian kernel density at each place of the grid, in one pass and without a row for each pair."""
    v = F.col(value).cast("double")
    bells = [F.avg(F.exp(-F.pow((v - float(g)) / bandwidth, F.lit(2.0)) / 2)) / (bandwidth * sqrt(2 * pi)) for g in grid]
    row = df.where(F.col(value).isNotNull()).agg(F.array(*bells).alias("d"))
    return row.select(F.posexplode("d").alias("k", "density")).select(F.get(F.array(*[F.lit(float(g)) for g in grid]), F.col("k")).alias("at"), "density")


def histogram(df: DataFrame, value: str, width: float, *by: str) -> DataFrame:
    """(by, bin, n): counts of values by bins [bin * width, (bin + 1) * width)."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.floor(F.col(value) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
