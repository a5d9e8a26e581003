"""Selections, updates, lookups, order and set operations on the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which running_totals cuts an axis, and buckets into which hash_numbered deals the rows of a group.
RANGES, HASH_BUCKETS = 256, 1024
#: A dimension is broadcast up to this many rows, counted first; beyond it the join shuffles.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its size allows it."""
    return F.broadcast(df) if df.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else df


def delete_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: str, column: str, default=None) -> DataFrame:
    """A column of another table by key; with a default, keys without a match keep their row."""
    out = df.join(table.select(on, column), on, "inner" if default is None else "left")
    return out if default is None else out.withColumn(column, F.coalesce(column, F.lit(default)))


def at_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], column: str, default=None) -> DataFrame:
    """A column's value at each of some composite keys (rows, lines, parameters): the key columns and the value; the default where no row has the key."""
    found = keys.select(*on).join(df.select(*on, column), list(on), "left")
    return found if default is None else found.withColumn(column, F.coalesce(column, F.lit(default)))


def renumbered(lines: DataFrame, order: str, number: str, within: Sequence[str] = ()) -> DataFrame:
    """lines with their number from 0 in an order (of places along the axis, say), within groups; ties by the old number."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(order, number)) - 1
    return lines.withColumn(f"new_{number}", place)


def group_names(df: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Group names by id; ids over the number of groups fall to group 0, which has no name."""
    bounded = df.withColumn("grp", F.when(F.col("grp") > n_groups, 0).otherwise(F.col("grp")))
    return bounded.join(dimension(groups), "grp", "left")


def update(df: DataFrame, changes: DataFrame, on: Sequence[str], column: str, digits: int = 5) -> DataFrame:
    """New values for the keys that have one, rounded."""
    new = changes.select(*on, F.round(column, digits).alias("__new"))
    return df.join(new, list(on), "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def from_template(keys: DataFrame, template: DataFrame) -> DataFrame:
    """The template's parameter rows for every key. The template is a few rows, sized before it is broadcast."""
    return keys.crossJoin(dimension(template))


def numbered(df: DataFrame, *order: Column | str, within: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 1 in an order, within groups."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def ranged(df: DataFrame, order: str) -> DataFrame:
    """df with __range, the place's range on an axis that is cut at quantiles into RANGES ranges at most; NaN is in a range of its own, the last.

    Rows without an order have no place and go.
    """
    df = df.where(F.col(order).isNotNull())
    cuts = sorted(set(df.select(F.col(order).cast("double").alias("v")).where(~F.isnan("v")).approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)))
    finite = [c for c in cuts if abs(c) < float("inf")]
    ranges = Bucketizer(splits=[float("-inf"), *finite, float("inf")], inputCol="__v", outputCol="__range", handleInvalid="keep") if finite else None
    cut = df.withColumn("__v", F.col(order).cast("double"))
    return ranges.transform(cut).drop("__v") if ranges else cut.withColumn("__range", F.lit(0.0)).drop("__v")


def running_totals(df: DataFrame, order: str, sums: Sequence[str], within: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """df with cum_<c> of each summed column, over rows up to and including this one in an order of distinct numbers.

    Two levels: the totals of an axis's ranges are added up first, so no task holds more than a group's
    rows of one range. Rows without an order have no place and go. Ties keep an arbitrary order;
    aggregate them before.
    """
    cut = ranged(df, order)
    direction = F.desc if descending else F.asc
    place = [*within, "__range"]
    totals = cut.groupBy(*place).agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    before = Window.partitionBy(*within).orderBy(direction("__range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*place, *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums))
    inside = Window.partitionBy(*place).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in place]
    summed = cut.select("*", *(F.sum(c).over(inside).alias(f"__s_{c}") for c in sums)).alias("d").join(offsets.alias("o"), same)
    return summed.select(*(F.col(f"d.{c}") for c in df.columns), *((F.col(f"__s_{c}") + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums))


def hash_numbered(df: DataFrame, key: str, seed: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """df with hash_no, the rows' numbers from 1 in a seeded hash order of a key, and hash_rows, their count, within groups.

    The hash deals each group into HASH_BUCKETS buckets that are numbered apart and moved by what lies
    before them, so a group of a third of all rows is no one task's. The same for any partitioning.
    """
    dealt = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__b", F.pmod(F.shiftright("__h", 32), F.lit(HASH_BUCKETS)))
    place = [*within, "__b"]
    group = Window.partitionBy(*within)
    counts = dealt.groupBy(*place).agg(F.count("*").alias("__c"))
    before = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*place, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"), F.sum("__c").over(group).alias("hash_rows"))
    inside = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(*place).orderBy("__h", key)))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in place]
    joined = inside.alias("d").join(offsets.alias("o"), same)
    return joined.select(*(F.col(f"d.{c}") for c in df.columns), (F.col("__n") + F.col("__o")).alias("hash_no"), "hash_rows")


def top(df: DataFrame, n: int, order: Column, tie: str, within: Sequence[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(order, tie))).where(F.col("rank") <= n)


def append_sorted(a: DataFrame, b: DataFrame, *order: str) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True).orderBy(*order)


def side_by_side(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Columns of two tables by key, never by position."""
    return a.join(b, on)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def range_lookup(df: DataFrame, value: str, borders: Sequence[float]) -> DataFrame:
    """The interval [start, end) that a value lies in, by the sorted borders; none outside."""
    edges = F.array(*[F.lit(float(b)) for b in sorted(borders)])
    k = F.size(F.filter(edges, lambda b: b <= F.col(value)))
    inside = (k >= 1) & (k < len(borders))
    return df.withColumn("interval", F.when(inside, k - 1)).where("interval is not null")


def pivot_features(points: DataFrame, names: Sequence[int]) -> DataFrame:
    """Wide table of key, group and one column for each given place."""
    return points.groupBy("key", "grp").pivot("i", list(names)).agg(F.first("y"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "feature", "value")


def interval_of(df: DataFrame, value: str, intervals: DataFrame) -> DataFrame:
    """Range join of values with a small table (start, stop, interval): start <= value < stop, the first that fits."""
    hit = df.join(dimension(intervals), (F.col(value) >= F.col("start")) & (F.col(value) < F.col("stop")))
    return hit.groupBy(*df.columns).agg(F.min("interval").alias("interval"))


def parameter_bounds(lines: DataFrame) -> DataFrame:
    """Bounds of the parameters of lines (key, line, a, x0, dx): height to twice, place within dx, width to half and twice; values pulled inside."""
    item = lambda n, v, lo, hi: F.struct(F.lit(n).alias("param"), F.least(F.greatest(v, lo), hi).alias("value"), lo.alias("min_value"), hi.alias("max_value"))
    a, x0, dx = F.col("a"), F.col("x0"), F.greatest(F.col("dx"), F.lit(1e-6))
    rows = F.array(item("a", a, F.lit(0.0), 2 * F.abs(a)), item("x0", x0, x0 - dx, x0 + dx), item("dx", dx, dx / 2, 2 * dx))
    return lines.select("key", "line", F.explode(rows).alias("p")).select("key", "line", "p.*")


def changed_parameters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parameter names that a change of line type adds or removes."""
    added = new.exceptAll(old).withColumn("change", F.lit("added"))
    return added.unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def active_features(features: DataFrame, ignored: DataFrame) -> DataFrame:
    """Features with their flag: active unless they are in the ignored table."""
    marks = ignored.select("feature").distinct().withColumn("__off", F.lit(True))
    return features.join(marks, "feature", "left").withColumn("active", F.col("__off").isNull()).drop("__off")


def regroup(df: DataFrame, changes: DataFrame) -> DataFrame:
    """New groups for the keys that have one, wherever a table holds keys."""
    return df.join(changes.select("key", F.col("grp").alias("__grp")), "key", "left").withColumn("grp", F.coalesce("__grp", "grp")).drop("__grp")


def next_free_index(df: DataFrame, index: str) -> DataFrame:
    """One row, index: the least whole number from the number of rows on that no row has.

    Of n rows, at most n numbers are taken, so the answer is at most 2n: the end of the run that starts at n.
    """
    n = df.agg(F.count("*").alias("n"))
    taken = df.select(F.col(index).cast("long").alias("i")).where(F.col("i").isNotNull()).distinct().crossJoin(F.broadcast(n)).where(F.col("i") >= F.col("n"))
    placed = running_totals(taken.withColumn("one", F.lit(1)), "i", ["one"])
    run = placed.where(F.col("i") == F.col("n") + F.col("cum_one") - 1).agg(F.max("i").alias("last"))
    return n.crossJoin(F.broadcast(run)).select(F.coalesce(F.col("last") + 1, F.col("n")).cast("long").alias(index))


def encoded(df: DataFrame, column: str, number: str) -> DataFrame:
    """df with the number of each value of a column among its distinct values in ascending order, from 0; null has none.

    The distinct values are classes; their table is joined as a dimension.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbers = numbered(values, column).select(column, (F.col("n") - 1).cast("double").alias(number))
    return df.join(dimension(numbers), column, "left")


def decoded(df: DataFrame, numbers: DataFrame, column: str, number: str) -> DataFrame:
    """The values back from their numbers, given the table of both."""
    return df.join(dimension(numbers.select(column, number).where(F.col(number).isNotNull()).distinct()), number, "left")
