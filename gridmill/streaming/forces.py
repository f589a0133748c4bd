"""Force series as a stream with state: frames are closed in the order of time, gaps become zeros, rewritten frames are replaced."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..shipping import ship

#: Seconds of a frame.
PERIOD = 43_200
#: Rows of a region that are taken in are (frame, seq, fx, fy); what leaves has seq -1 where a gap was filled.
OUT = "region int, frame int, seq long, fx double, fy double"

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FrameSeries(StatefulProcessor):
    """A region's frames.

    State: the next frame that was never seen, the first that is still open,
    and of open frames the seq of what was written last. A row for a frame
    beyond the next one fills what lies between with zeros; a row with a higher
    seq replaces what a frame holds. A timer at a frame's end closes it:
    then it is forgotten, and rows for it come too late.
    """

    def __init__(self, origin: int, period: int = PERIOD):
        self.origin, self.period = origin, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "next int, first int")
        self.open = handle.getMapState("open", "frame int", "seq long")

    def _end(self, frame: int) -> int:
        return (self.origin + (frame + 1) * self.period) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        region = key[0]
        following, first = self.ends.get() if self.ends.exists() else (0, 0)
        newest: dict[int, tuple[int, float, float]] = {}  # State is asked once for a frame, not for a row.
        for batch in rows:
            known = batch[batch["frame"] >= first].reset_index(drop=True)
            top = known.loc[known.groupby("frame")["seq"].idxmax()]
            for frame, seq, fx, fy in zip(top["frame"].tolist(), top["seq"].tolist(), top["fx"].tolist(), top["fy"].tolist(), strict=True):
                if frame not in newest or newest[frame][0] < seq:
                    newest[frame] = (seq, fx, fy)
        out: dict[int, tuple[int, float, float]] = {}
        for frame, row in sorted(newest.items()):
            for gap in range(following, frame):
                out[gap] = (-1, 0.0, 0.0)
                self._keep(gap, -1)
            if frame >= following:
                following = frame + 1
            elif self.open.containsKey((frame,)) and self.open.getValue((frame,))[0] >= row[0]:
                continue
            self._keep(frame, row[0])
            out[frame] = row
        self.ends.update((following, first))
        if out:
            yield pd.DataFrame([(region, f, *v) for f, v in sorted(out.items())], columns=["region", "frame", "seq", "fx", "fy"])

    def _keep(self, frame: int, seq: int) -> None:
        self.open.updateValue((frame,), (seq,))
        self.handle.registerTimer(self._end(frame))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = (expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.origin) // self.period
        following, first = self.ends.get()
        for frame in range(first, closed):
            if self.open.containsKey((frame,)):
                self.open.removeKey((frame,))
        self.ends.update((following, max(first, closed)))
        yield pd.DataFrame({"region": pd.Series(dtype="int32"), "frame": pd.Series(dtype="int32"), "seq": pd.Series(dtype="int64"), "fx": pd.Series(dtype="float64"), "fy": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def frame_changes(stream: DataFrame, origin: int, late: str, period: int = PERIOD) -> DataFrame:
    """OUT rows of a stream (ts, region, seq, fx, fy): every frame that was written, rewritten or passed over.

    Frames are numbered from ``origin`` (epoch seconds). What comes more than
    ``late`` behind the newest ts may find its frame closed.
    """
    ship(stream.sparkSession)
    known = stream.where("ts IS NOT NULL AND region IS NOT NULL AND seq IS NOT NULL").withWatermark("ts", late)
    frame = F.floor((F.unix_seconds("ts") - origin) / period).cast("int")
    rows = known.select("ts", F.col("region").cast("int").alias("region"), frame.alias("frame"), F.col("seq").cast("long").alias("seq"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fx", "fy")])
    return rows.where("frame >= 0").groupBy("region").transformWithStateInPandas(FrameSeries(origin, period), OUT, "Update", "EventTime")


def store_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its number; one that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_series(spark: SparkSession, path: str) -> DataFrame:
    """(region, frame, fx, fy): what each frame holds after all batches."""
    newest = Window.partitionBy("region", "frame").orderBy(F.desc("batch"))
    rows = spark.read.schema(f"{OUT}, batch int").parquet(path).withColumn("_n", F.row_number().over(newest))
    return rows.where("_n = 1").select("region", "frame", "fx", "fy")


def replay(spark: SparkSession, rows: DataFrame, folder: str, origin: int, late: str, files: int, starts: int, period: int = PERIOD) -> DataFrame:
    """``current_series`` of rows(ts, region, seq, fx, fy) that come in ``files`` shuffled files, with the stream stopped and started again ``starts`` - 1 times."""
    session = spark.newSession()  # its settings are its own
    session.conf.set(*STORE)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))  # each keeps a store of its own
    parts = rows.withColumn("part", F.pmod(F.xxhash64("region", "seq", "ts"), F.lit(files)).cast("int"))
    name = f"{folder}/forces-{uuid.uuid4().hex}"
    parts.repartition("part").write.partitionBy("part").parquet(f"{name}/all")
    for start in range(starts):
        landed = spark.read.parquet(f"{name}/all").where(f"part % {starts} = {start}").drop("part")
        landed.write.mode("append").parquet(f"{name}/landed")
        stream = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // starts)).parquet(f"{name}/landed")
        store_changes(frame_changes(stream, origin, late, period), f"{name}/out", f"{name}/state").awaitTermination()
    return current_series(spark, f"{name}/out")
