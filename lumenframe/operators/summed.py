"""Sums of dense arrays over all rows: each task adds up its own, Spark adds up the tasks', and slots keep each part small."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a task that passes over them again and again, where they are more than one task a core.
TASK_ROWS = 1 << 16

#: Arrays of one slot travel as the packed bytes of whole numbers or doubles; histograms are mostly zeros.
_SLOT = "slot long, sum binary"


def held(df: DataFrame, rows: int, key: str = "key") -> DataFrame:
    """df kept for many passes, dealt by its key into a task a core, or into tasks of TASK_ROWS rows if these are more; rows is its count.

    Without it, each pass has a task for each partition of the shuffle before, however few the rows.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), key).persist()


def _record(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(a.tobytes(), 1) for a in sums.values()], pa.binary())], names=["slot", "sum"])


def add_up(df: DataFrame, work: Callable[[pa.RecordBatch], dict[int, np.ndarray]], finish: Callable[[int, np.ndarray], pa.Table], schema: str, dtype: type = np.int64) -> DataFrame:
    """finish(slot, sum) of each slot's array, summed over all batches of df: work gives a batch's arrays by slot.

    A task sends one array a slot, and a slot is added up and finished in one task; nothing of the arrays reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for slot, a in work(b).items():
                    held[slot] = held[slot] + a if slot in held else a
        if held:
            yield _record(held)

    def reduced(key: tuple, rows: pa.Table) -> pa.Table:
        return finish(key[0].as_py(), sum(np.frombuffer(zlib.decompress(b), dtype) for b in sorted(rows["sum"].to_pylist())))

    return df.mapInArrow(run, _SLOT).groupBy("slot").applyInArrow(reduced, schema)


def totals(df: DataFrame, work: Callable[[pa.RecordBatch], dict[int, np.ndarray]], dtype: type = np.float64) -> dict[int, np.ndarray]:
    """The summed arrays by slot, on the driver: for sums of a model's size."""
    whole = lambda slot, a: pa.table({"slot": pa.array([slot], pa.int64()), "sum": pa.array([a.tobytes()], pa.binary())})
    return {r["slot"]: np.frombuffer(r["sum"], dtype) for r in add_up(df, work, whole, _SLOT, dtype).collect()}
