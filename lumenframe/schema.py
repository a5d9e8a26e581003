"""The two layouts of spectra and how tables become spectra.

Array layout: one row a spectrum (key, grp, x, y) - what runs within a spectrum stays
in its row and needs no shuffle.  Long layout: one row a point (key, grp, i, x, y) - for
what meets across spectra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPECTRA = "key long, grp int, x array<double>, y array<double>"
#: Axis given to tables that hold values only: x = START + STEP * i.
START, STEP = 300.0, 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as spectra: the place in the array is the axis, the label the group."""
    y = F.col("embedding").cast("array<double>")
    x = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.lit(START) + F.lit(STEP) * i)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("grp"), x.alias("x"), y.alias("y"))


def to_points(spectra: DataFrame, *values: str) -> DataFrame:
    """Array layout to long layout; further array columns of the same length come along."""
    extra = values or ("y",)
    zipped = F.posexplode(F.arrays_zip("x", *extra)).alias("i", "p")
    return spectra.select("key", "grp", zipped).select("key", "grp", "i", "p.*")


def to_spectra(points: DataFrame) -> DataFrame:
    """Long layout to array layout, in the order of i."""
    rows = points.groupBy("key", "grp").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    return rows.select("key", "grp", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
