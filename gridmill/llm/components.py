"""Connected components of a link table, by alternating star contractions.

Each round joins links with their nodes' smallest neighbours twice and cuts its
lineage through the checkpoint folder. No link or component reaches the driver:
it reads two numbers a round, to see whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(others).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node.

    Nodes of any ordered type. Links of a node with itself, repeated links and
    links with a null end do no harm; an empty table gives no rows.
    """
    ordered = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = checkpointed(ordered)
    mark = _mark(now)
    while mark[0]:
        now = checkpointed(_small_star(_large_star(now)))
        then, mark = mark, _mark(now)
        if then == mark:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
