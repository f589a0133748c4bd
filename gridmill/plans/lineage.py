"""Cutting the lineage of loops, and generated code into methods."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder of spark.checkpoint.dir.

    A temporary folder stands in only where none is named and everything runs
    in one process, as in tests: elsewhere executors wouldn't share it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridmill-checkpoint-"))
    return df.checkpoint(eager=True)


#: More partitions than there are: a coalesce to so many leaves them as they are.
ALL_PARTITIONS = 1 << 20


def apart(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions; what follows is generated as code of its own.

    Spark writes a chain of projections into one method, and the JVM compiles
    none of more than 8,000 bytes: such a one is interpreted, many times slower.
    A coalesce ends the method; it moves nothing.
    """
    return df.coalesce(ALL_PARTITIONS)
