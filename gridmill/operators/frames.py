"""Stored frames, forces, snapshots and caches."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .fields import BITS, CONSTANT, quantise_all

#: Fields of a frame.
FIELDS = ("jpinv", "p", "q", "vx", "vy")


def _replace_partitions(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_frame(frame: DataFrame, path: str, number: int) -> None:
    """Store a frame; one stored before under the number is replaced, others stay."""
    narrow = frame.withColumn("frame", F.lit(number)).select(*[F.col(f.name).cast(f.dataType) for f in schema.FRAMES.fields])
    _replace_partitions(narrow, path, "frame")


def read_frame(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One frame; only its folder is read."""
    return spark.read.parquet(path).where(F.col("frame") == number)


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def frame_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(frame) of all stored frames, from the folders' names alone; no file is opened."""
    store, at = _store(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()]
    found = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"frame=(\d+)", n)))
    return spark.createDataFrame([(n,) for n in found], "frame int")


def write_quantised_frame(frame: DataFrame, path: str, number: int, bits: int = BITS) -> None:
    """Store a frame whose fields are whole numbers of 0 to 2^bits - 1, with each field's range beside it.

    A range is the same in every row, so Parquet keeps it once for each page. A
    frame stored before under the number is replaced.
    """
    ranged = quantise_all(frame, list(FIELDS), bits)
    ints = [F.col(c).cast("int").alias(c) for c in ("i", "j", *FIELDS)]
    rest = [F.col(c).cast("short").alias(c) for c in ("r", "g", "b", "mask")]
    ends = [F.col(f"{e}_{c}").cast("double").alias(f"{e}_{c}") for c in FIELDS for e in ("low", "high")]
    narrow = ranged.select(F.lit(number).alias("frame"), *ints, *rest, *ends, F.lit(bits).alias("bits"))
    _replace_partitions(narrow, path, "frame")


def read_quantised_frame(spark: SparkSession, path: str, number: int) -> DataFrame:
    """A frame with its fields restored, each to half a step of its range; only its folder is read."""
    stored = spark.read.parquet(path).where(F.col("frame") == number)
    top = F.pow(F.lit(2.0), F.col("bits")) - 1

    def value(c: str) -> Column:
        low, span = F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}")
        return F.when(span < CONSTANT, low).otherwise(low + F.col(c) * span / top).alias(c)

    return stored.select("frame", "i", "j", *map(value, FIELDS), "r", "g", "b", "mask")


def write_forces(forces: DataFrame, path: str, number: int) -> None:
    """Upsert a frame's forces(region, fx, fy)."""
    narrow = forces.withColumn("frame", F.lit(number)).select(*[F.col(f.name).cast(f.dataType) for f in schema.FORCES.fields])
    _replace_partitions(narrow, path, "frame")


def force_series(forces: DataFrame, regions: int) -> DataFrame:
    """(frame, region, fx, fy) for every frame up to the last and every region; gaps are 0.

    Missing rows are made from the last frame's number, which is one row.
    """
    last = forces.agg(F.max("frame").alias("last")).where("last IS NOT NULL")
    every = last.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame"))
    every = every.select("frame", F.explode(F.sequence(F.lit(0), F.lit(regions - 1))).alias("region"))
    sums = forces.groupBy("frame", "region").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    full = every.join(sums, ["frame", "region"], "left")
    return full.select("frame", "region", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fx", "fy")])


def write_snapshot(particles: DataFrame, path: str, number: int, step: int, time: float) -> None:
    """Store all particles of a time with a row of metadata.

    Both are written to a folder beside it and moved there together, so a crash
    leaves the snapshot that was there before, or none, but no half of one.
    """
    spark, name = particles.sparkSession, f"{path}/s{number:05d}"
    fresh = f"{path}/.s{number:05d}-{uuid.uuid4().hex}"
    particles.select(*schema.PARTICLES.names).write.parquet(f"{fresh}/points")
    count = spark.read.parquet(f"{fresh}/points").count()
    meta = spark.createDataFrame([(number, step, time, count)], "snapshot int, step long, time double, n long")
    meta.coalesce(1).write.parquet(f"{fresh}/meta")
    store, target = _store(spark, name)
    store.delete(target, True)
    if not store.rename(_store(spark, fresh)[1], target):
        raise OSError(f"the snapshot can't be moved to {name}")


def read_snapshot(spark: SparkSession, path: str, number: int) -> tuple[DataFrame, int, float]:
    """Particles, step and time; raises if columns or the number of rows are wrong."""
    meta = spark.read.parquet(f"{path}/s{number:05d}/meta").first()
    points = schema.checked(spark.read.parquet(f"{path}/s{number:05d}/points"), schema.PARTICLES, "the snapshot")
    if (n := points.count()) != meta["n"]:
        raise ValueError(f"the snapshot has {n} points, not {meta['n']}")
    return points, meta["step"], meta["time"]


def write_path_ids(path_ids: DataFrame, path: str) -> None:
    """path_ids(k, name) as one CSV file without a header; a map has at most some hundred paths."""
    path_ids.orderBy("k").coalesce(1).write.mode("overwrite").csv(path, header=False)


def read_path_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="k int, name string", header=False)


def write_map(pixels: DataFrame, path: str) -> None:
    """Store a prepared map: path index, normal, ice status and thickness of every pixel."""
    rows = pixels.withColumns({c: F.lit(0.0) for c in ("nx", "ny") if c not in pixels.columns})
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.MAP_PX.fields]).write.mode("overwrite").parquet(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return schema.checked(spark.read.parquet(path), schema.MAP_PX, "the map")


def write_flow(flow: DataFrame, path: str) -> None:
    """Store flow(x, y, vx, vy) with the norm of each velocity."""
    rows = flow.withColumn("norm", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.FLOW.fields]).write.mode("overwrite").parquet(path)


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    return schema.checked(spark.read.parquet(path), schema.FLOW, "the flow")


def write_point_colours(points: DataFrame, path: str) -> None:
    """Store the colours of points(pid, r, g, b), packed into one number each."""
    packed = F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b"))
    points.select(F.col("pid").cast("long"), packed.cast("int").alias("rgb")).write.mode("overwrite").parquet(path)


def with_point_colours(particles: DataFrame, colours: DataFrame) -> DataFrame:
    """Particles with the colours of their points, by an equi-join on pid; black where a point has none."""
    rgb = F.coalesce("rgb", F.lit(0))
    channels = {c: F.shiftright(rgb, by).bitwiseAND(0xFF) for c, by in (("r", 16), ("g", 8), ("b", 0))}
    return particles.drop(*"rgb").join(colours.select("pid", "rgb"), "pid", "left").withColumns(channels).drop("rgb")
