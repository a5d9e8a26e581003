"""Names: groups from file names, feature and legend names, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_of(name: Column) -> Column:
    """A leading number; else one digit in [ ]; else the first digit of a number in ( ); else 0."""
    part = lambda p: F.try_to_number(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit("9999999999")).cast("int")
    return F.coalesce(part(r"^(\d{1,9})"), part(r"^\[(\d)\]"), part(r"^\((\d)\d*\)"), F.lit(0))


def _two_places(x: Column) -> Column:
    return F.round(x, 2).cast("string")


def feature_name(x: Column) -> Column:
    return F.concat(F.lit("k"), _two_places(x))


def legend(x: Column) -> Column:
    return F.concat(F.lit("k"), F.replace(_two_places(x), F.lit("."), F.lit("dot")), F.lit("_"))


def legend_value(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[k_]", ""), "dot", ".").cast("double")


def parameter_parts(name: Column) -> Column:
    """Curve_10_x0 -> (line 10, parameter x0)."""
    parts = F.split(name, "_", 3)
    return F.struct(F.get(parts, F.lit(1)).cast("int").alias("line"), F.get(parts, F.lit(2)).alias("param"))


def feature_value(name: Column) -> Column:
    return F.regexp_replace(name, "k|_a|_x0", "").cast("double")


def prediction_text(name: Column, probabilities: Column) -> Column:
    whole = F.transform(probabilities, lambda p: F.round(p * 100).cast("int").cast("string"))
    return F.concat(name, F.lit(" ["), F.array_join(whole, " "), F.lit("]"))


def point_text(x: Column, y: Column) -> Column:
    return F.format_string("%10.5f %10.5f", x, y)


def title(method: str, **params) -> str:
    """A method and its settings as a title: `Whittaker (lam: 2.0, order: 2)`."""
    told = ", ".join(f"{k}: {v}" for k, v in params.items())
    return f"{method} ({told})" if told else method


def title_text(method: Column, params: Column) -> Column:
    """The same of a column and a map of settings, in the order of their names."""
    pairs = F.array_sort(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return F.when(F.size(params) > 0, F.concat(method, F.lit(" ("), F.array_join(pairs, ", "), F.lit(")"))).otherwise(method)
