"""Incremental ingestion and event windows.  The engine's own workload is batch; these are extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest_new(spark: SparkSession, folder: str, schema: StructType, target: str, state: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Processes the files that arrived since the last call and appends the result; each batch is written once.

    A batch goes to its own folder under its number, replaced if it is written again, so a retried batch leaves no
    second copy.  ``state`` must be on storage that all executors share.
    """

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/lote={number}")

    spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, late: str = "1 hour", size: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and tumbling window of event time; later rows than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("desde"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: bounded state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users: runs of events no further apart than ``gap``."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("desde"), "n")
