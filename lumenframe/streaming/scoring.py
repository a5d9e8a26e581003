"""An extension: pipelines over spectra that keep arriving, and windowed event counts with late data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.plans.pipeline import Step, apply
from lumenframe.schema import SPECTRA
from lumenframe.sources.project import load_production


def preprocess_stream(spark: SparkSession, source: str, steps: Sequence[Step], sink: str, checkpoint: str) -> StreamingQuery:
    """Parquet spectra that land in a folder, each processed by itself, appended to the sink; state is none."""
    stream = spark.readStream.schema(SPECTRA).parquet(source)
    return apply(stream, steps).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_stream(spark: SparkSession, project: str, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Predictions of a saved production project for the Parquet spectra that land in a folder.

    The project is loaded once.  Each batch of files goes through its frozen steps, template and models, and
    overwrites its own folder of the sink (batch=<number>), so a batch that is run again after a failure is there once.
    """
    production = load_production(spark, project)

    def one(batch: DataFrame, number: int) -> None:
        production.predict(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(SPECTRA).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type over tumbling windows; rows later than the watermark are left out of closed windows when streamed."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
