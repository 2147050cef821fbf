"""Windowed counts that work on a stream and on a batch alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _counted(events: DataFrame, window: Column, kind: str, keys: list[str], time: str, late: str) -> DataFrame:
    """start, keys, n. A stream's event time must be of an instant, so times without a zone become instants of the
    session's zone, and the starts times again."""
    zoneless = isinstance(events.schema[time].dataType, T.TimestampNTZType)
    timed = events.withColumn(time, F.col(time).cast("timestamp")) if zoneless and events.isStreaming else events
    grouped = timed.withWatermark(time, late).groupBy(window, *keys).agg(F.count("*").alias("n"))
    start = F.col(f"{kind}.start")
    return grouped.select((start.cast("timestamp_ntz") if zoneless else start).alias("start"), *keys, "n")


def tumbling_counts(events: DataFrame, size: str, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _counted(events, F.window(time, size), "window", keys, time, late)


def sliding_counts(events: DataFrame, size: str, step: str, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _counted(events, F.window(time, size, step), "window", keys, time, late)


def session_counts(events: DataFrame, gap: str, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _counted(events, F.session_window(time, gap), "session_window", keys, time, late)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now and return what it has written as Parquet below ``path``.

    Results go to files of the shared folder, never to driver memory. With ``append`` a window is written once the
    watermark has passed it; ``complete`` writes the whole result of the last batch.
    """
    spark, schema = stream.sparkSession, stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", f"{path}/rows")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows"))
    writer.start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows")
