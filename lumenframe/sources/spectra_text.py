"""Spectrum text files: two columns of numbers, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import labels


def read(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """filename, grp, min_nm, max_nm, x, y of each .txt or .asc file; '#' starts a comment; known file names are left out.

    Files are read whole, one row each, so the order of lines needs no shuffle.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = files.select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("filename"), "value")
    files = files.where(F.lower("filename").rlike(r"\.(txt|asc)$"))
    if known is not None:
        files = files.join(known.select("filename"), "filename", "left_anti")
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda s: F.split(F.trim(F.regexp_replace(F.regexp_replace(s, "#.*", ""), r"\s+", " ")), " ")), lambda p: F.size(p) >= 2)
    parsed = files.withColumn("p", lines)
    column = lambda k: F.transform("p", lambda p: F.get(p, F.lit(k)).cast("double"))
    out = parsed.select("filename", labels.group_of(F.col("filename")).alias("grp"), column(0).alias("x"), column(1).alias("y"))
    return out.select("filename", "grp", F.array_min("x").alias("min_nm"), F.array_max("x").alias("max_nm"), "x", "y")


def write(spectra: DataFrame, path: str) -> None:
    """One folder a spectrum, lines of '%10.5f %10.5f' in the order of the axis."""
    lines = F.transform(F.arrays_zip("x", "y"), lambda p: labels.point_text(p["x"], p["y"]))
    spectra.select("key", F.array_join(lines, "\n").alias("value")).write.partitionBy("key").text(path)


def write_csv(wide: DataFrame, path: str) -> None:
    wide.write.option("header", "true").csv(path)
