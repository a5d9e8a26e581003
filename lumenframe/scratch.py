"""Where lineage ends: reliable checkpoints in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from tempfile import gettempdir

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set: the one that spark.checkpoint.dir names, or one set before.

    Where neither is named, a local folder serves a session of one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or f"{gettempdir()}/lumenframe-checkpoints")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the checkpoint folder."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
