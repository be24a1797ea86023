"""Windowed counts and a growing bank over streams, with watermarks for late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.operators.banks import keep_last


def event_stream(spark: SparkSession, path: str, at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder or pattern, `at_once` of them per batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", at_once).parquet(path)


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events (ts, event_type, value) per window and type: rows and the sum of value in hundredths; works on tables too.

    Rows more than `late` behind the newest seen may be left out by a stream.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    by = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("rows"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("hundredths"))
    return by.select(F.col("w.start").alias("start"), "event_type", "rows", "hundredths")


def keep_first(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """A growing bank: each key once, the first row seen within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def versions(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch as one version of a bank; a batch that is run again replaces its own version."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/version={number}")


def bank(spark: SparkSession, folder: str, keys: list[str], order: str, version: int | None = None) -> DataFrame:
    """The last row of each key in the versions up to `version` (None: all), by version and then by order."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/version=*")
    rows = rows if version is None else rows.where(F.col("version") <= version)
    return keep_last(rows, keys, F.struct("version", order)).drop("version")


def drain(stream: DataFrame, folder: str, mode: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there now, each batch to sink; folder holds its checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", folder).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
