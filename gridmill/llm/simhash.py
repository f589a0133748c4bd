"""SimHash near-duplicates by a self-join of binary tries.

Documents with equal fingerprints form one class, and classes are joined. A
trie over sorted fingerprints is a set of index ranges. The self-join starts
at the pair of the root with itself, steps down both nodes of every pair at
once, adds a differing bit for each unlike step and drops a pair as soon as its
bits exceed the budget.

Of budget + 1 blocks of bits, two fingerprints within the budget share one.
So for each block the fingerprints are turned until that block leads, and the
tries below each value of it are joined on their own. A value that holds too
many fingerprints is split by its next bits into pairs of smaller tries, as far
as they can lie within the budget.

Defined results: a null text counts as empty; texts without words have
fingerprint 0 and are linked like any other; an empty table gives no rows. Rows
that share id and text count as one document. A null id is passed through and
is never the smallest. Texts of any length are read whole. Extra columns are ignored, or kept by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed, map_arrow
from .components import components

#: Fingerprints of one block value that a single task joins; more are split.
GROUP_ROWS = 200_000
#: Share of all rows, as one in so many, beyond which a fingerprint's class counts as large.
MOST_LARGE = 1000
#: Fingerprints joined side by side, and node pairs expanded at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 100_000, 1 << 19
#: Words in a shingle, differing bits of a link, and the hash's seed.
WORDS, BITS, SEED = 3, 2, 42

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    parts = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()[words - 1 :] or [len(line)]
    hashes = [xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, last, strict=False)]
    data = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    bits = 0
    for byte in range(8):
        ones = np.bincount(data[:, byte], minlength=256) @ _BYTE_BITS
        bits |= int(((2 * ones > len(data)) << np.arange(8)).sum()) << (8 * byte)
    return bits


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) of every document; fp holds the bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or b"", words) for t in batch.column(2).to_pylist()]
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "text_hash", "fp"])

    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")
    )
    return map_arrow(rows, run, "doc_id long, text_hash long, fp long")


class Forest:
    """Joins many small tries at once; keeps links as a forest, not as pairs."""

    def __init__(self, keys: np.ndarray, budget: int):
        """keys: unsigned, sorted within each trie."""
        self.keys, self.budget = keys, budget
        self.root = np.arange(len(keys))
        self.low: dict[int, np.ndarray] = {}

    def zeros(self, depth: int) -> np.ndarray:
        """Zero bits at this depth among the keys before each index."""
        if depth not in self.low:
            zero = (self.keys >> np.uint64(63 - depth)) & np.uint64(1) == 0
            self.low[depth] = np.concatenate([[0], np.cumsum(zero)])
        return self.low[depth]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the trees of the forest that hold the rows of a and b."""
        while len(a):
            a, b = self._top(a), self._top(b)
            open_ = a != b
            a, b = np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_])
            np.minimum.at(self.root, a, b)

    def _top(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if np.array_equal(up, x):
                return x
            self.root[x] = self.root[up]
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of nodes as index ranges a and b of shape (n, 2), equal for a node with itself."""
        stack = [(a, b, np.zeros(len(a), np.int64), 0)]
        while stack:
            a, b, spent, depth = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                stack += [(a[:half], b[:half], spent[:half], depth), (a[half:], b[half:], spent[half:], depth)]
                continue
            own = (a[:, 0] == b[:, 0]) & (a[:, 1] == b[:, 1])
            one = (a[:, 1] - a[:, 0] == 1) & (b[:, 1] - b[:, 0] == 1)
            if np.any(one & ~own):
                x, y = a[one & ~own, 0], b[one & ~own, 0]
                near = np.bitwise_count(self.keys[x] ^ self.keys[y]) <= self.budget
                self.link(x[near], y[near])
            go = ~one
            a, b, spent, own = a[go], b[go], spent[go], own[go]
            if not len(a) or depth > 63:
                continue
            z = self.zeros(depth)
            mid_a, mid_b = a[:, 0] + z[a[:, 1]] - z[a[:, 0]], b[:, 0] + z[b[:, 1]] - z[b[:, 0]]
            a0, a1 = np.stack([a[:, 0], mid_a], 1), np.stack([mid_a, a[:, 1]], 1)
            b0, b1 = np.stack([b[:, 0], mid_b], 1), np.stack([mid_b, b[:, 1]], 1)
            to_a = np.concatenate([a0, a1, a0, a1[~own]])
            to_b = np.concatenate([b0, b1, b1, b0[~own]])
            cost = np.concatenate([spent, spent, spent + 1, spent[~own] + 1])
            alive = (cost <= self.budget) & (to_a[:, 1] > to_a[:, 0]) & (to_b[:, 1] > to_b[:, 0])
            stack.append((to_a[alive], to_b[alive], cost[alive], depth + 1))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        top = self._top(np.arange(len(self.root)))
        linked = np.flatnonzero(top != np.arange(len(top)))
        return linked, top[linked]


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of budget + 1 blocks that make up 64 bits."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(i, j - i) for i, j in zip(edges, edges[1:], strict=False)]


def _turned(fp: Column, left: int) -> Column:
    return fp if left == 0 else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


def _join_groups(rows: np.ndarray, budget: int, blocks: list[tuple[int, int]]) -> pa.RecordBatch:
    """Links (a, b) of whole groups; rows: (block, value, one, other, key)."""
    keys = rows[:, 4].astype(np.uint64)
    order = np.lexsort((keys, rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
    rows, keys = rows[order], keys[order]
    edge = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1)) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(rows)]])
    many = end - start > 1
    start, end = start[many], end[many]
    forest = Forest(keys, budget)
    whole = rows[start, 2] == rows[start, 3]
    ranges = np.stack([start, end], 1)
    forest.join(ranges[whole], ranges[whole])
    if len(split := np.flatnonzero(~whole)):
        # Two tries under unlike prefixes part at the first bit that varies.
        first, last = keys[start[split]], keys[end[split] - 1]
        bit = np.array([int(x).bit_length() - 1 for x in (first ^ last).tolist()]).clip(0).astype(np.uint64)
        bounds = last >> bit << bit
        at = [i + int(np.searchsorted(keys[i:j], b)) for i, j, b in zip(start[split], end[split], bounds, strict=True)]
        forest.join(np.stack([start[split], at], 1), np.stack([at, end[split]], 1))
    x, y = forest.links()
    turned = np.array([first for first, _ in blocks], np.uint64)[rows[:, 0]]
    back = np.where(turned == 0, keys, (keys >> turned) | (keys << ((np.uint64(64) - turned) & np.uint64(63))))
    fps = back.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(fps[x]), pa.array(fps[y])], ["a", "b"])


def links(fps: DataFrame, budget: int = BITS, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Links (a, b) that connect whatever the budget links, for distinct fps(fp).

    Each task's links form a forest, so there are fewer of them than rows.
    """
    blocks = _blocks(budget)
    turns = [(i, w, _turned(F.col("fp"), first)) for i, (first, w) in enumerate(blocks)]
    rows = fps.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("long").alias("block"),
                        F.shiftrightunsigned(key, 64 - w).alias("value"),
                        key.alias("key"),
                    )
                    for i, w, key in turns
                ]
            )
        )
    )
    groups = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS)
    largest = groups.agg(F.max("n")).first()[0]
    if largest is None:
        rows = rows.withColumns({"one": F.lit(0).cast("long"), "other": F.lit(0).cast("long")})
    else:
        bits = min(16, int(np.ceil(np.log2(largest / GROUP_ROWS))) + 1)
        width = F.element_at(F.array(*[F.lit(w) for _, w in blocks]), F.col("block").cast("int") + 1)
        rows = rows.join(checkpointed(groups), ["block", "value"], "left").withColumn("width", width)
        rows = rows.withColumn("prefix", F.expr(f"shiftrightunsigned(shiftleft(key, width), {64 - bits})"))
        masks = F.array(*[F.lit(m).cast("long") for m in range(1 << bits) if m.bit_count() <= budget])
        rows = rows.withColumn("mask", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(None).cast("long"))).otherwise(masks)))
        split = F.col("prefix").bitwiseXOR(F.col("mask"))
        rows = rows.withColumns(
            {
                "one": F.when(F.col("mask").isNull(), F.lit(0).cast("long")).otherwise(F.least("prefix", split)),
                "other": F.when(F.col("mask").isNull(), F.lit(0).cast("long")).otherwise(F.greatest("prefix", split)),
            }
        )
    group = ["block", "value", "one", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
            size += batch.num_rows
            if size >= rows_at_once:
                rows = np.concatenate(held)
                # The last group may go on in the next batch.
                other = np.flatnonzero(np.any(rows[:, :4] != rows[-1, :4], axis=1))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield _join_groups(rows[:cut], budget, blocks)
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield _join_groups(np.concatenate(held), budget, blocks)

    placed = rows.select(*group, "key").repartition(*group).sortWithinPartitions(*group)
    return map_arrow(placed, run, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, budget: int = BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, fp, keeper_hash) of every document.

    component_id is the smallest id reachable over links; keeper_hash is the
    text hash of the row that stands for the component.
    """
    # Narrow rows are dealt anew before they are stored, so that there are as few files as their size asks for.
    prints = checkpointed(fingerprints(docs, id_col, text_col, words).repartition("doc_id", "text_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = checkpointed(prints.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(classes.select("fp"), budget), "a", "b")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    leaders = rooted.groupBy("root").agg(F.min("first").alias("leader"))
    named = rooted.join(leaders, "root").select("fp", "leader", "n")
    # Large classes, of which there are MOST_LARGE at most, go to the rows; the rows of the others go to their classes.
    rows = classes.agg(F.sum("n")).first()[0] or 0
    large = named.where(F.col("n") > F.lit(rows // MOST_LARGE)).select("fp", "leader")
    found = prints.join(F.broadcast(large), "fp").unionByName(
        prints.join(F.broadcast(large), "fp", "left_anti").join(named.select("fp", "leader"), "fp").select("fp", "doc_id", "text_hash", "leader")
    )
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("leader.doc_id").alias("component_id"),
        "text_hash",
        F.col("leader.text_hash").alias("keeper_hash"),
    )


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, budget: int = BITS) -> DataFrame:
    """(id, text_hash) of the rows other than the one that stands for their component."""
    found = simhash_components(docs, id_col, text_col, words, budget)
    keeps = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("keeper_hash"))
    return found.where(~keeps).select(F.col("doc_id").alias("id"), "text_hash")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, budget: int = BITS) -> DataFrame:
    """One document for each component, columns as given; of rows that share its id and text one stays."""
    found = simhash_components(docs, id_col, text_col, words, budget)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("keeper_hash")))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("hash"),
    )
    stay = rows.join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    return stay.dropDuplicates(["id", "hash"]).select("row.*")
