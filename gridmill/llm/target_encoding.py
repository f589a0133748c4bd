"""Target encoding ordered in time, with folds, by time-major snapshots.

A row's history is every row of another fold that lies more than ``gap`` before
it. For each key column the history's rows with the row's own value are counted,
and their rate is smoothed towards that of the value's parent, which in turn is
smoothed towards the rate of all history.

Time is cut into slices of about SLICE_ROWS events. Each slice has a snapshot:
for every value that occurs in it, the sums by fold of all earlier slices. With
its snapshot a slice is replayed on its own: sums live in hash maps, and a row
joins them once ``gap`` has passed, by a second pointer that runs behind the
first. A row that asks and the same row that is released later belong to the
slices of their own times, so no gap is too long for a slice. An instant that
holds a slice's worth of rows is a slice of its own; as its rows don't see each
other it is dealt into parts.

Snapshots are running sums in two levels, over blocks of slices and within a
block, so that the most frequent value meets in no task as a whole.

Defined results: a null key is a value like any other, and so is a null parent,
which unknown keys share. Of several parents of a key the smallest counts. Rows
of one instant don't see each other. Rows without a time are left out; an empty
table gives no rows. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ._base import checkpointed, stored

#: Events of a slice, about.
SLICE_ROWS = 100_000
#: Slices whose running sums start from one sum.
BLOCK_SLICES = 1024
#: Bits of an instant (in microseconds) by which sums of times are nested: a second, an hour, half a year.
TIME_BITS = (20, 12, 12)


@dataclass(frozen=True)
class Smoothing:
    """Rates are in millionths; ``prior`` is that of no history, ``weight`` how many rows the parent's rate stands for."""

    prior: int = 500_000
    weight: int = 50
    folds: int = 5
    gap: int = 0


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp as microseconds; one without a zone is read as it stands, whatever the session's zone."""
    at = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(at)
    day = F.unix_date(F.to_date(at)).cast("long") * 86_400_000_000
    second = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return day + F.hour(at).cast("long") * 3_600_000_000 + F.minute(at).cast("long") * 60_000_000 + second


def fold_of(id_: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)).cast("int")


def with_before(counts: DataFrame, bits: tuple[int, ...] = TIME_BITS) -> DataFrame:
    """counts(at, n) with ``before``, the sum over all earlier instants; no task gets more than the instants of one span."""
    n_before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not bits:
        return counts.withColumn("before", n_before)  # spans of half a year
    span = F.shiftright("at", bits[0])
    above = with_before(counts.groupBy(span.alias("at")).agg(F.sum("n").alias("n")), bits[1:])
    here = Window.partitionBy("span").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("span", span).withColumn("within", F.coalesce(F.sum("n").over(here), F.lit(0)))
    starts = above.select(F.col("at").alias("span"), F.col("before").alias("start"))
    return within.join(starts, "span").select("at", "n", (F.col("start") + F.col("within")).alias("before"))


def time_slices(counts: DataFrame, slice_rows: int) -> DataFrame:
    """(at, slice, parts) from counts(at, n): slices in the order of time; only a slice of one instant has several parts."""
    large = F.col("n") >= slice_rows
    block = F.floor(F.col("before") / slice_rows) * 2
    parts = F.when(large, F.ceil(F.col("n") / slice_rows)).otherwise(1)
    return with_before(counts).select("at", (block + large.cast("long")).alias("slice"), parts.cast("int").alias("parts"))


def _sums(folds: int) -> list[str]:
    return [f"{what}{k}" for what in "ns" for k in range(folds)]


def _own_sums(events: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """(slice, part, level, key, sums): what each part of a slice releases under each value that occurs in it."""
    of = F.array(
        *[
            F.struct((F.lit(2 * i) + F.col(k).isNull().cast("int")).alias("level"), F.coalesce(F.col(k), F.lit(0).cast("long")).alias("key"))
            for i, k in enumerate(keys)
        ]
    )
    flat = events.select("slice", "part", "release", "fold", "n", "s", F.inline(of))
    sums = [
        F.sum(F.when(F.col("release") & (F.col("fold") == k), F.col(what)).otherwise(0)).alias(f"{what}{k}") for what in "ns" for k in range(folds)
    ]
    return flat.groupBy("slice", "part", "level", "key").agg(*sums)


def _parents(parents: list[DataFrame]) -> DataFrame:
    """(level, key, parent) of all key columns, one row a key."""
    levels = [
        p.toDF("key", "parent").where("key IS NOT NULL").select(F.lit(2 * i).alias("level"), F.col("key").cast("long"), F.col("parent").cast("string"))
        for i, p in enumerate(parents)
    ]
    both = levels[0]
    for other in levels[1:]:
        both = both.unionByName(other)
    return both.groupBy("level", "key").agg(F.min("parent").alias("parent"))


def snapshots(events: DataFrame, keys: list[str], parents: list[DataFrame], folds: int) -> DataFrame:
    """(slice, part, level, key, parent, sums): the sums of all earlier slices for each value that occurs in a part of a slice.

    level: 2 i for key column i (2 i + 1 for its null), 2 len(keys) + i for its parents, whose key is 0, and -1 for all rows.
    """
    sums = _sums(folds)
    own = stored(_own_sums(events, keys, folds).join(_parents(parents), ["level", "key"], "left"))
    added = [F.sum(c).alias(c) for c in sums]
    column = F.floor(F.col("level") / 2)
    by_parent = own.groupBy("slice", "part", (F.lit(2 * len(keys)) + column).cast("int").alias("level"), "parent").agg(*added)
    of_all = own.where("level < 2").groupBy("slice", "part").agg(*added)  # every event has a value in the first column
    levels = (
        own.unionByName(by_parent.withColumn("key", F.lit(0).cast("long")))
        .unionByName(of_all.withColumns({"level": F.lit(-1), "key": F.lit(0).cast("long"), "parent": F.lit(None).cast("string")}))
        .withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES))
        .withColumn("value", F.coalesce(F.concat(F.lit("v"), "parent"), F.lit("")))
        .withColumn("value", F.when(F.col("level") >= 2 * len(keys), F.col("value")).otherwise(""))
    )
    of = ["level", "key", "value"]
    # Of a slice's parts none sees another, so frames end before the slice, not the row.
    past = Window.partitionBy(*of, "block").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*of).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = levels.groupBy(*of, "block").agg(*added).select(*of, "block", *[F.coalesce(F.sum(c).over(blocks), F.lit(0)).alias(f"start_{c}") for c in sums])
    within = levels.select("slice", "part", *of, "block", "parent", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in sums])
    return within.join(starts, [*of, "block"]).select(
        "slice", "part", "level", "key", "parent", *[(F.col(c) + F.col(f"start_{c}")).alias(c) for c in sums]
    )


def _replayed(places: np.ndarray, asks: list[int], frees: list[int], at: list[int], free_at: list[int], fold: np.ndarray, n: list[int], s: list[int], start: tuple[np.ndarray, np.ndarray]):
    """History counts of each asking row: its value's sums without those of its own fold, once what is due has been released."""
    cells = (places * start[0].shape[1] + fold).tolist()
    of_fold_n, of_fold_s = (x.ravel().tolist() for x in start)
    of_all_n, of_all_s = (x.sum(axis=1).tolist() for x in start)
    places = places.tolist()
    got_n, got_s, waiting, last = [], [], 0, len(frees)
    for row in asks:
        now = at[row]
        while waiting < last and free_at[waiting] < now:
            free = frees[waiting]
            cell, place, count = cells[free], places[free], n[free]
            of_fold_n[cell] += count
            of_all_n[place] += count
            if count := s[free]:
                of_fold_s[cell] += count
                of_all_s[place] += count
            waiting += 1
        cell, place = cells[row], places[row]
        got_n.append(of_all_n[place] - of_fold_n[cell])
        got_s.append(of_all_s[place] - of_fold_s[cell])
    return np.array(got_n, np.int64), np.array(got_s, np.int64)


def rates(n: np.ndarray, s: np.ndarray, prior: np.ndarray | int, weight: int) -> np.ndarray:
    return np.where(n < 1, prior, (1_000_000 * s + weight * prior) // np.maximum(n + weight, 1))


def replay_slice(rows: pa.Table, state: pa.Table, keys: list[str], carried: list[str], how: Smoothing) -> pa.Table:
    """The asking rows of one part of a slice with their counts and rates."""
    order = np.argsort(rows["at"].to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    at = rows["at"].to_numpy().tolist()
    fold, n, s = rows["fold"].to_numpy(), rows["n"].to_pylist(), rows["s"].to_pylist()
    ask, free = (np.flatnonzero(rows[c].to_numpy()).tolist() for c in ("ask", "release"))
    free_at = [at[k] for k in free]

    levels, values, parents = state["level"].to_pylist(), state["key"].to_pylist(), state["parent"].to_pylist()
    top = 2 * len(keys)
    place: dict[tuple, int] = {
        (level, parent if level >= top else key): k for k, (level, key, parent) in enumerate(zip(levels, values, parents, strict=True))
    }

    start = tuple(np.stack([state[f"{what}{k}"].to_numpy() for k in range(how.folds)], axis=1) for what in "ns")

    def history(places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return _replayed(np.array(places, np.int64), ask, free, at, free_at, fold, n, s, start)

    base = rates(*history([place[-1, 0]] * len(at)), how.prior, how.weight)
    out = rows.select(carried).take(pa.array(ask, pa.int64()))
    for i, name in enumerate(keys):
        of_key = [place[2 * i, v] if v is not None else place[2 * i + 1, 0] for v in rows[name].to_pylist()]
        up = [place[top + i, parents[k]] for k in of_key]
        prior = rates(*history(up), base, how.weight)
        count, positive = history(of_key)
        out = out.append_column(f"{name}_n", pa.array(count)).append_column(f"{name}_rate", pa.array(rates(count, positive, prior, how.weight)))
    return out


def time_ordered_rates(
    rows: DataFrame, keys: list[str], parents: list[DataFrame], carried: list[str], how: Smoothing | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """The ``carried`` columns of rows with <key>_n and <key>_rate for each key column.

    rows(at, fold, n, s, keys…, carried…): at in microseconds; a row stands for n
    rows, s of them positive. parents: for each key column a table of (key, parent).
    """
    how = how or Smoothing()
    columns = list(dict.fromkeys(["fold", "n", "s", *keys, *carried]))
    rows = rows.where("at IS NOT NULL AND fold IS NOT NULL")
    if how.gap:
        asks = F.struct(F.col("at"), F.lit(True).alias("ask"), F.lit(False).alias("release"))
        frees = F.struct((F.col("at") + how.gap).alias("at"), F.lit(False).alias("ask"), F.lit(True).alias("release"))
        timed = rows.select(*columns, F.inline(F.array(asks, frees)))
    else:
        timed = rows.select(*columns, "at", F.lit(True).alias("ask"), F.lit(True).alias("release"))
    slices = time_slices(checkpointed(timed.groupBy("at").agg(F.count(F.lit(1)).alias("n"))), slice_rows)
    deal = F.pmod(F.xxhash64(*keys, *carried), F.col("parts")).cast("int")
    events = stored(timed.join(slices, "at").withColumn("part", deal).drop("parts").repartition("slice", "part"))
    state = snapshots(events, keys, parents, how.folds)

    types = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), *(f"`{k}_{what}` bigint" for k in keys for what in ("n", "rate"))])
    ship(rows.sparkSession)

    def replay(left: pa.Table, right: pa.Table) -> pa.Table:
        return replay_slice(left, right, keys, carried, how)

    return events.groupBy("slice", "part").cogroup(state.groupBy("slice", "part")).applyInArrow(replay, schema)


def sale_line_rates(
    lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, how: Smoothing | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Per sale_id, item_id, vendor_id: own lines and the smoothed share of returned ones among earlier lines of item, vendor and client.

    Lines without a sale or a time are left out; a null item or client is -1. A
    sale_id that has several sales joins its lines to each of them, and has rows for each.
    """
    how = how or Smoothing()
    none = F.lit(-1).cast("long")
    kinds = (
        lines.where("sale_id IS NOT NULL")
        .groupBy("sale_id", F.coalesce("item_id", none).alias("item"), F.col("vendor_id").alias("vendor"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag") == "returned").alias("s"))
    )
    sold = (
        sales.where("sale_id IS NOT NULL AND sold_at IS NOT NULL")
        .groupBy("sale_id", micros(sales, "sold_at").alias("at"), F.coalesce("client_id", none).alias("client"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    rows = kinds.join(sold, "sale_id").select(
        "sale_id", "at", "item", "vendor", "client", fold_of(F.col("sale_id"), how.folds).alias("fold"),
        (F.col("n") * F.col("copies")).alias("n"), (F.col("s") * F.col("copies")).alias("s"),
    )
    parents = [items.select("item_id", "kind"), vendors.select("vendor_id", "nation_id"), clients.select("client_id", "segment")]
    found = time_ordered_rates(stored(rows), ["item", "vendor", "client"], parents, ["sale_id", "item", "vendor", "n", "s"], how, slice_rows)
    return found.select(
        "sale_id", F.col("item").alias("item_id"), F.col("vendor").alias("vendor_id"), F.col("n").alias("n_lines"), F.col("s").alias("n_returned"),
        "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate",
    )
