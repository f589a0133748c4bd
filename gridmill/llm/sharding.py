"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a
ring table. Appending a shard moves rows only into the new one, about one in
n + 1 of them.

Defined results: rows with a null key share one shard; a null text has no
bytes (size 1, CRC 0), and texts of any length count whole; an empty table
gives no rows. Rows equal in key, size
and checksum are interchangeable and get consecutive slots. Extra columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ._base import checkpointed

#: Rows of a shard that one task numbers, about.
BUCKET_ROWS = 20_000
#: Copies of one row that are written out at once.
COPIES_AT_ONCE = 10_000

#: The generator of the published jump consistent hash.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of every key by Lamping and Veach's jumps, all keys at a time."""
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = jump[moving]
        state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
        stride = float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[moving] = ((shard[moving] + 1) * stride).astype(np.int64)
        moving = moving[jump[moving] < n_shards]
    return shard.astype(np.int32)


def shard_of(key: Column, n_shards: int) -> Column:
    """Shard of a key column of any type."""
    ship(SparkSession.active())

    @F.pandas_udf("int")
    def shard(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashes.to_numpy().view(np.uint64), n_shards))

    return shard(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str, n_shards: int, column: str = "shard") -> DataFrame:
    """The input with the shard of each row as one more (or replaced) column."""
    return df.withColumn(column, shard_of(F.col(key), n_shards))


def write_shards(df: DataFrame, key: str, n_shards: int, path: str) -> None:
    """Write one folder per shard; tasks keep their rows, nothing is shuffled."""
    assign_shards(df, key, n_shards).write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_manifest(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and next shard of every document.

    Slots are numbered in two levels: rows fall into hash buckets of a shard,
    buckets are numbered by their own order and sums, and what precedes a
    bucket is added. Equal rows are counted before the shuffle and written out
    after it, so no key, however frequent, meets in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    kinds = checkpointed(
        kinds.withColumns(
            {"shard": shard_of(F.col("doc_id"), n_shards), "grown_shard": shard_of(F.col("doc_id"), n_shards + 1)}
        )
    )
    n_buckets = max(1, kinds.count() // (n_shards * BUCKET_ROWS))
    kinds = kinds.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_buckets)))

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        kinds.groupBy("shard", "bucket")
        .agg(F.sum("n").alias("in_bucket"))
        .select("shard", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    )
    within = (
        Window.partitionBy("shard", "bucket")
        .orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = kinds.withColumn("offset", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_AT_ONCE))))
    first = F.col("start") + F.col("offset") + F.col("run") * COPIES_AT_ONCE
    last = F.least(first + COPIES_AT_ONCE, F.col("start") + F.col("offset") + F.col("n")) - 1
    return runs.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(first, last)).alias("slot"),
        "grown_shard",
    )
