"""Mixing sources to target weights by hash-threshold histograms.

A source's target is met by whole passes over it and, for the rest, by the
documents whose key hash lies below a threshold. Words are summed by source
and hash bucket, the bucket in which the budget ends is found by cumulative
sums, and only that bucket is split further, until a single hash is left. The
mix is then a filter on the hash; documents are never sorted.

Defined results: a null text has size 0; a null source is a source of its own
and ranks last; sources without words have target 0; an empty table gives an
empty mix. Rows equal in id and text are told apart by their place in the input,
so a source's mix misses its target by about half a document, or by a 4096th of
the copies of one row where these are more. Texts are counted whole, whatever
their length. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import checkpointed, stored, word_count

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_PASSES = 3
#: Bits of the hash, and bits by which a histogram splits a bucket.
HASH_BITS, LEVEL_BITS = 60, 12
#: The last bits of the hash, which part rows equal in id and text.
PART_BITS = 12
#: A per-source table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def row_hash(id_: Column, text: Column) -> Column:
    """60 bits: 48 of the MD5 of id and text, so that neither alone moves rows together, and 12 that part equal rows."""
    named = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(1)), F.lit(1 << PART_BITS))
    return F.shiftleft(F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("long"), PART_BITS).bitwiseOR(part)


def _by_source(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    named = per_source.withColumnRenamed("source", "_source")
    small = F.broadcast(named) if n_sources <= BROADCAST_SOURCES else named
    return rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank from 0 by code point, null last, in range partitions."""
    spread = checkpointed(
        sources.repartitionByRange(8, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    )
    sizes = {r["part"]: r["n"] for r in spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start = F.lit(0)
    for part in sizes:
        start = F.when(F.col("part") == part, sum(n for p, n in sizes.items() if p < part)).otherwise(start)
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return spread.withColumn("rank", start + F.row_number().over(order) - 1).drop("part")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Target of every row of sources(source, source_size), as (…, target).

    The whole of all sizes is shared by weight. A share above ``max_passes``
    times its source stops there and the excess is shared among the others,
    again until none is above. Each round is one aggregate over the sources.
    """
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    weighed = checkpointed(ranked.withColumn("weight", weight))
    top = max_passes * F.col("source_size")
    total = weighed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    rest, shared = total["s"] or 0, total["w"] or 1
    while True:
        over = F.lit(float(rest)) * F.col("weight") / F.lit(shared) > top
        now = weighed.agg(
            F.coalesce(F.sum(F.when(over, top)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("w"),
        ).first()
        then = ((total["s"] or 0) - now["held"], now["w"] or 1)
        if then == (rest, shared):
            break
        rest, shared = then
    share = F.lit(float(rest)) * F.col("weight") / F.lit(shared)
    return weighed.withColumn("target", F.when(share > top, top.cast("double")).otherwise(share)).drop("rank", "weight")


def thresholds(sized: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """For budgets(source, rest): the hash below which documents are taken.

    Gives (source, limit, whole): documents with a smaller hash are taken, and
    those at ``limit`` itself where ``whole`` is true. It is true when half of
    what lies at the limit still fits, so a source misses its budget by half
    a document at most.
    """
    state = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        inside = _by_source(sized, state, n_sources).where(
            F.shiftrightunsigned("hash", shift + LEVEL_BITS) == F.col("prefix") if level > 1 else F.lit(True)
        )
        histogram = inside.groupBy("source", F.shiftrightunsigned("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"),
            F.min("hash").alias("low"),
            F.max("hash").alias("high"),
            F.first("below").alias("below"),
            F.first("rest").alias("rest"),
        )
        up = Window.partitionBy("source").orderBy("bucket")
        ends = histogram.withColumn("end", F.col("below") + F.sum("words").over(up))
        boundary = ends.where(F.col("end") > F.col("rest")).groupBy("source").agg(
            F.min_by(F.struct("bucket", "words", "low", "high", "end", "rest"), "bucket").alias("b")
        )
        found = checkpointed(
            boundary.select("source", "b.*").select(
                "source",
                "rest",
                F.col("bucket").alias("prefix"),
                (F.col("end") - F.col("words")).alias("below"),
                "words",
                "low",
                "high",
            )
        )
        state = found.select("source", "rest", "prefix", "below")
        if found.where("low <> high").isEmpty():
            break
    return found.select("source", F.col("low").alias("limit"), (F.col("below") + F.col("words") / 2 <= F.col("rest")).alias("whole"))


def mix_plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> tuple[DataFrame, int]:
    """Plan per source of sized(source, size, hash), and the number of sources.

    Columns: source, source_size, target, passes, limit, whole.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = checkpointed(targets(sources, weights, max_passes))
    n_sources = aimed.count()
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    aimed = aimed.withColumn("passes", F.least(passes, F.lit(max_passes)).cast("long"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    limits = thresholds(sized, aimed.select("source", rest.alias("rest")), n_sources)
    plan = aimed.alias("a").join(limits.alias("l"), F.col("a.source").eqNullSafe(F.col("l.source")), "left")
    plan = plan.select("a.*", F.coalesce("limit", F.lit(0)).alias("limit"), F.coalesce("whole", F.lit(False)).alias("whole"))
    return checkpointed(plan), n_sources


def _copies(hash_: Column) -> Column:
    extra = (hash_ < F.col("limit")) | ((hash_ == F.col("limit")) & F.col("whole"))
    return F.col("passes") + extra.cast("long")


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        row_hash(F.col(id_col), F.col(text_col)).alias("hash"),
    )


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of every document."""
    sized = checkpointed(sized_documents(docs, id_col, text_col, source_col).repartition("hash"))
    plan, n_sources = mix_plan(sized)
    return _by_source(sized, plan, n_sources).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("hash"))).alias("taken"), "source"
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, columns as given."""
    # Hashed once: a row keeps the hash that the plan has counted, whatever order a recomputation would give.
    rows = stored(
        docs.select(
            F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), row_hash(F.col(id_col), F.col(text_col)).alias("hash")
        )
    )
    sizes = rows.select("source", word_count(F.col("row")[text_col]).alias("size"), "hash")
    plan, n_sources = mix_plan(checkpointed(sizes.repartition("hash")))
    return (
        _by_source(rows, plan, n_sources)
        .select("row", F.explode(F.array_repeat(F.lit(1), _copies(F.col("hash")).cast("int"))).alias("copy"))
        .select("row.*")
    )
