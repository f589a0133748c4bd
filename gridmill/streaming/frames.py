"""Streams of timed values as frames. An extension: the batch operators have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frames import write_forces


def frame_sums(stream: DataFrame, period: str = "1 day", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """(frame_start, region, fx, n) of a stream of (ts, region, value) in tumbling windows.

    Values later than ``late`` are dropped, as the state of a closed window is.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    windowed = timed.groupBy(F.window(at, period), "region")
    sums = windowed.agg(F.sum("value").alias("fx"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.col("window.start").alias("frame_start"), "region", "fx", "n")


def store_forces(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch of (region, fx, fy) as the frame of its number; a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("region").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        write_forces(sums, path, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
