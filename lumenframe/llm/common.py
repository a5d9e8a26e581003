"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from tempfile import gettempdir

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()), "double": (T.DoubleType(), pa.float64()), "string": (T.StringType(), pa.string())}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a checkpoint folder set before.

    Where neither is named, a local folder serves a session of one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    own = sc._jsc.sc().getCheckpointDir()
    if not named and own.isDefined():
        return str(own.get())
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"{gettempdir()}/lumenframe-checkpoints"
    if own.isEmpty():
        sc.setCheckpointDir(named)
    return named


def beside(rows: DataFrame, keys: list[str], column: str, work: Callable[[list[str]], dict], added: dict[str, str]) -> DataFrame:
    """The key columns of every row as they are, beside what work makes of a batch of texts: one value a row for each added column.

    Null texts are empty.  Keys never leave Arrow: pandas would turn whole numbers beside a null into floats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = work([t or "" for t in b.column(len(keys)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(made[c], _TYPES[t][1]) for c, t in added.items())], names=[*keys, *added])

    chosen = rows.select(*keys, column)
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[: len(keys)], *(T.StructField(c, _TYPES[t][0]) for c, t in added.items())]))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there.

    The folder goes when the driver's JVM ends, or when freed() is told that nothing reads it any more.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def freed(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of frames from written(), once all that is made of them has been written itself."""
    for frame in frames:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is a multiple of 5. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about so many characters, one text at least in each."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
