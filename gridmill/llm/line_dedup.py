"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words. Two lines match if the Jaccard
similarity of their sets is MATCH or more, and a line is removed if it matches
an earlier one: one with a smaller (id, text hash, line number). Documents are known
by id, all 64 bits of the text's hash, and whether the id is null.

1. Words are counted over all documents by hash bucket. A word's level is the
   logarithm of its bucket's count; rarer words come first in a line.
2. A line is listed under each rare word of its prefix, the rarest words of which
   a matching line must share one. Where frequent words reach into the prefix, the
   line is also listed under tuples of neighbours among its frequent words, a
   prefix of which matching lines share as well (``Lines.keys``). So a line has
   at most about 0.4 times as many keys as words, however frequent they are.
3. Lines of a task with equal sets are settled there and then. Listed lines travel
   as packed arrays, one for each task and bucket of keys, and lists are joined
   where they meet: equal sets are settled, other lines become candidates if
   they pass the length, positional and parity filters. The last compares the
   parities of hashed words, which can't differ in more bits than the sets do in
   words. A list of more than Bounds.hot unlike lines is cut into chunks, and every
   pair of chunks is joined by a task of its own.
4. A line's best candidates in each list, those that differ least in parity, are
   verified on the whole sets. Lines that match none of them, though a list held
   more, are compared with every line of such lists.

Defined results: lines without words are kept and match nothing; a null text
has no lines. Rows that share id and text count as one document and stay alike;
rows with equal ids, or none, and unlike texts are told apart by the text's hash.
Null ids come last. An empty
table gives no rows. A text is held whole by the task that reads it, whatever
its length; what is made of it grows in proportion. Extra columns are ignored,
or kept by ``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import checkpointed, map_arrow

#: Lines match from here on: MATCH[0] / MATCH[1].
MATCH = (4, 5)
#: Buckets of the word counts, and levels of a doubling.
BUCKET_BITS, LEVELS = 20, 8
#: A word with more occurrences counts as frequent; neighbours in a tuple of frequent words.
FREQUENT, TUPLE = 20_000, 2
#: Smallest set that can match an unequal one.
SMALLEST = 4
#: Sets up to this size have one word of parities, larger ones two.
ONE_WORD = 16
#: Bytes of text cut up, and pairs of listed lines compared at once.
BYTES_AT_ONCE, PAIRS_AT_ONCE = 1 << 19, 1 << 18
#: Least buckets of keys in a shuffle partition, and listed lines in a bucket, about: there are as many buckets as both ask for.
BUCKETS, BUCKET_ROWS = 8, 200_000
#: Parts in which rows that share id and text are numbered.
PARTS = 1024
#: Slices in which word counts are added up.
SLICES = 64
#: Bits of the filters that pick lines and keys.
PICK_BITS = 25
#: Stands for a null id in the order, so that such rows come last; a flag above the line number tells it from an id.
NO_ID, NONE_BIT = (1 << 63) - 1, 32
#: By which signed numbers get the order of unsigned ones.
SIGN = -(1 << 63)
#: What names a line.
LINE = ["id", "hash", "line"]


@dataclass(frozen=True)
class Bounds:
    """What a task takes up at once. The result is the same whatever these are."""

    #: Listed lines that are packed or held at once.
    rows: int = 200_000
    #: Lines of a list that one task joins; of longer lists, every pair of chunks has a task.
    hot: int = 20_000
    #: Lists that are joined at once, by size; longer ones are joined in blocks of ``side`` lines.
    short: int = 1024
    side: int = 64
    #: Candidates of a line that are taken from each list; if they fail, the line is compared with all of the list.
    tries: int = 8


BOUNDS = Bounds()

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(max(n, BYTES_AT_ONCE), base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and line number of every word of texts laid end to end."""
    data = _LOWER[data]
    space = _SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # texts don't run into each other
    word = ~space
    before = np.concatenate([[True], space[:-1]]) | fresh[:-1]
    after = np.concatenate([space[1:], [True]]) | fresh[1:]
    start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    powers, inverses = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    hashes = _mix((sums[end] - sums[start]) * inverses[start], 0xD6E8FEB86659FD93)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    doc = np.searchsorted(offsets, start, "right") - 1
    return hashes, doc, newlines[start] - newlines[offsets[doc]]


def cut_shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and line number 0 of every stretch of so many words, lines disregarded.

    A text with fewer words is one stretch, and so is one without any.
    """
    hashes, doc, _ = cut_words(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    many = np.maximum(count - words + 1, 1)
    owner = np.repeat(np.arange(len(count)), many)
    at = (np.cumsum(count) - count)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    width = np.minimum(count, words)[owner]
    out = width.astype(np.uint64)
    for k in range(words):
        some = np.flatnonzero(width > k)
        out[some] = _mix(out[some] * np.uint64(_BASE) + hashes[at[some] + k], 0xD6E8FEB86659FD93)
    return out, owner, np.zeros(len(owner), np.int64)


def _cut(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return cut_shingles(data, offsets, words) if words else cut_words(data, offsets)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts of a batch as (first, last, bytes, offsets), a bounded number of bytes at a time."""
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _order(line: np.ndarray, level: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order by line, level and hash."""
    if len(line) and line[-1] < 1 << 20:
        code = line.astype(np.uint64) << np.uint64(44) | level.astype(np.uint64) << np.uint64(36) | hashes >> np.uint64(28)
        order = np.argsort(code)
        code, hashes_ = code[order], hashes[order]
        if not np.any((code[1:] == code[:-1]) & (hashes_[1:] != hashes_[:-1])):
            return order
    return np.lexsort((hashes, (line << 8) | level))


class Lines:
    """The word sets of a stretch of texts, rarest words first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, levels: np.ndarray, wanted=None, words: int = 0):
        """``wanted``: says which of the lines (document, number) to keep; ``words``: whole texts as sets of shingles."""
        hashes, doc, number = _cut(data, offsets, words)
        if wanted is not None and len(doc):
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])]))
            keep = np.repeat(wanted(doc[first], number[first]), np.diff(np.concatenate([first, [len(doc)]])))
            hashes, doc, number = hashes[keep], doc[keep], number[keep]
        line = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])) if len(doc) else doc
        level = levels[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        order = _order(line, level, hashes)
        hashes, line, self.level = hashes[order], line[order], level[order]
        first = np.concatenate([[True], (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])]) if len(line) else np.zeros(0, bool)
        keep = np.flatnonzero(first)
        self.hashes, line, self.level = hashes[keep], line[keep], self.level[keep]
        self.start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        self.size = np.diff(np.concatenate([self.start, [len(line)]])).astype(np.int64)
        source = order[keep][self.start]
        self.doc, self.number = doc[source], number[source]

    @classmethod
    def of_sets(cls, sets: pa.ListArray, levels: np.ndarray) -> Lines:
        """From the word hashes of lines that are known to have some, rarest first."""
        lines = cls.__new__(cls)
        lines.hashes = sets.flatten().to_numpy().view(np.uint64)
        lines.level = levels[(lines.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        lines.size = np.array([len(x) for x in sets], np.int64)
        lines.start = np.cumsum(lines.size) - lines.size
        return lines

    def __len__(self) -> int:
        return len(self.start)

    def signatures(self) -> np.ndarray:
        """A 64-bit name of each set."""
        if not len(self):
            return np.zeros(0, np.uint64)
        return np.add.reduceat(_mix(self.hashes, 0x9FB21C651E98DF25), self.start) + self.size.astype(np.uint64)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """64 parities of each line's hashed words, and of large sets those of half of the words."""
        bit = np.uint64(1) << (self.hashes & np.uint64(63))
        low = np.bitwise_xor.reduceat(bit, self.start)
        second = (self.hashes >> np.uint64(6)) & np.uint64(1) == 1
        high = np.bitwise_xor.reduceat(np.where(second, bit, np.uint64(0)), self.start)
        return low, np.where(self.size > ONE_WORD, high, np.uint64(0))

    def keys(self, chosen: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, place in ``chosen``, position in the set, whether it is the line's first key) of the lists of the chosen lines.

        Matching lines share a word of their prefixes. If that is a rare one,
        they meet under it. Otherwise both prefixes reach frequent words, and
        all their rare words, which come first, differ. Of the frequent words
        they share ``least_overlap`` at least, and each differing word parts
        at most one pair of neighbours, so they share neighbours too, and a
        prefix of these in their common order. A shared pair needn't be the
        first shared word, so it has position 0: nothing is known about what
        lies before it. Sets below SMALLEST match equal ones alone and have
        one key.
        """
        size, start = self.size[chosen], self.start[chosen]
        if not len(chosen):
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(bool)
        prefix = prefix_length(size)
        rare = np.add.reduceat((self.level <= frequent).astype(np.int64), self.start)[chosen]
        large = size >= SMALLEST
        single = np.where(large, np.minimum(rare, prefix), 0)
        pairs = np.where(large & (rare < prefix), size - rare - least_neighbours(size, rare), 0)
        row, pos = _ramp(single)
        row2, step = _ramp(pairs)
        at = start[row2] + rare[row2] + step
        both = _mix(self.hashes[at] * np.uint64(5) + self.hashes[np.minimum(at + 1, len(self.hashes) - 1)], 0xA0761D6478BD642F)
        small = np.flatnonzero(~large)
        own = _mix(self.signatures()[chosen][small], 0x8CB92BA72F3D8DD7)
        keys = np.concatenate([self.hashes[start[row] + pos], both, own]) >> np.uint64(16)  # 48 bits are plenty for lists
        first = np.concatenate([pos == 0, (step == 0) & (single[row2] == 0), np.ones(len(small), bool)])
        none = np.zeros(len(step) + len(small), np.int64)
        return keys.view(np.int64), np.concatenate([row, row2, small]), np.concatenate([pos, none]), first

    def sets(self, chosen: np.ndarray) -> pa.ListArray:
        """The word hashes of the chosen lines, rarest words first."""
        ends = np.concatenate([[0], np.cumsum(self.size[chosen])])
        at = np.arange(ends[-1]) + np.repeat(self.start[chosen] - ends[:-1], self.size[chosen])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(self.hashes[at].view(np.int64)))


def _ramp(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of items: whose each item is, and its number from 0."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def least_overlap(a, b):
    """Words that sets of sizes a and b must share: a match share / (1 + share) of both."""
    top, bottom = MATCH
    return -(-top * (a + b) // (top + bottom))


def prefix_length(size: np.ndarray) -> np.ndarray:
    top, bottom = MATCH
    return size + (-top * size) // bottom + 1


def least_neighbours(size: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Pairs of neighbours that the frequent words of matching lines share, if no rare word is shared.

    For a line of ``size`` words of which ``rare`` are rare, with a line of
    any size that it can match. The least repeats over sums of sizes with the
    period of the match, so one period from the least sum on is enough.
    """
    top, bottom = MATCH
    lowest, highest = size - (-top * size) // bottom, size + size * bottom // top
    least = size
    for step in range(top + bottom):
        both = np.minimum(lowest + step, highest)
        share = least_overlap(both, 0)
        least = np.minimum(least, share - 1 - np.maximum(both - 2 * share - rare, 0))
    return least


def word_levels(docs: DataFrame, text_col: str = "text", words: int = 0) -> tuple[np.ndarray, int]:
    """Level of every bucket of words, counted over all documents, a fixed number of bytes; and the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in _parts(batch.column(0)):
                hashes, _, _ = _cut(data, offsets, words)
                counts += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        yield _slices(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    counted = map_arrow(docs.select(F.col(text_col).cast("binary").alias("text")), count, schema)
    found = map_arrow(counted.repartition("slice"), add, schema).toArrow()
    levels = np.zeros(1 << BUCKET_BITS, np.int64)
    total, width = 0, len(levels) // SLICES
    for k, counts in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        n = np.frombuffer(counts, np.int64)
        levels[k * width : (k + 1) * width] = np.log2(np.maximum(n, 1)) * LEVELS
        total += int(n.sum())
    return levels.clip(0, 255).astype(np.uint8), total


def _slices(counts: np.ndarray) -> pa.RecordBatch:
    """A task's counts in slices of equal length, to be added slice by slice."""
    parts = [c.tobytes() for c in np.split(counts, SLICES)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], ["slice", "counts"])


def _name(id_col: str, text_col: str) -> list[Column]:
    """What a document is known by: id, hash and none (1 for a null id), in the order of documents."""
    id_ = F.col(id_col).cast("long")
    return [
        F.coalesce(id_, F.lit(NO_ID)).alias("id"),
        F.xxhash64(text_col).bitwiseXOR(F.lit(SIGN)).alias("hash"),
        id_.isNull().cast("long").alias("none"),
    ]


def _none(line: Column) -> Column:
    return F.shiftright(line, NONE_BIT).alias("none")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, none, text)."""
    return docs.select(*_name(id_col, text_col), F.col(text_col).cast("binary").alias("text"))


def _names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents (id, hash, none, …): ids, hashes, and what their line numbers are added to."""
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy() << NONE_BIT


def frequent_level() -> int:
    return int(np.log2(FREQUENT) * LEVELS)


class Listed:
    """Lines under their keys, as rows of columns.

    Columns: key, the line's name (id, text hash, line number), signature, two
    words of parities, and shape: size of the set, position of the key in it,
    and whether the key is the line's first. Shape -1 is a line settled already.
    """

    WIDTH = 8

    def __init__(self, rows: np.ndarray, bounds: Bounds):
        self.rows, self.bounds = rows, bounds
        self.key, self.id, self.hash, self.line, self.sig, low, high, self.shape = rows
        self.name = rows[1:4]
        self.low, self.high = low.view(np.uint64), high.view(np.uint64)
        self.size, self.pos = self.shape >> 32, (self.shape & 0xFFFFFFFF) >> 1

    def __len__(self) -> int:
        return self.rows.shape[1]

    def collapsed(self) -> tuple[Listed, np.ndarray]:
        """The earliest line of each set under each key, in order of key and size; the names of what that settles."""
        done = self.shape < 0
        order = np.argsort(self.key)
        group = np.cumsum(np.concatenate([[0], self.key[order[1:]] != self.key[order[:-1]]])) if len(order) else order
        if len(order) and group[-1] < 1 << 20:
            name = (self.sig[order].view(np.uint64) >> np.uint64(36)).view(np.int64)
            order = order[np.argsort(group << 44 | np.clip(self.size[order], 0, 0xFFFF) << 28 | name)]
        else:
            order = np.lexsort((self.sig, self.size, self.key))
        order = order[~done[order]]
        named = self.rows[[0, 4, 5]][:, order]
        size = self.size[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any(named[:, 1:] != named[:, :-1], axis=0) | (size[1:] != size[:-1])
        first = _earliest(order, fresh, self.name)
        again = order[self.other(order, first) & (self.shape[order] & 1 == 1)]
        settled = self.name[:, np.concatenate([np.flatnonzero(done), again])]
        return Listed(self.rows[:, first[fresh]], self.bounds), settled

    def other(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a and b are unlike lines."""
        return (self.id[a] != self.id[b]) | (self.hash[a] != self.hash[b]) | (self.line[a] != self.line[b])

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a come after rows b."""
        same_id, same_text = self.id[a] == self.id[b], self.hash[a] == self.hash[b]
        return (self.id[a] > self.id[b]) | (same_id & ((self.hash[a] > self.hash[b]) | (same_text & (self.line[a] > self.line[b]))))

    def compare(self, later: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the arrays of those that may match, and in how many parities these differ."""
        # Sets of sizes x and y match only if they differ in (x + y) / 9 words at most.
        differ = np.bitwise_count(self.low[later] ^ self.low[earlier]).astype(np.int64)
        x, y = self.size[later], self.size[earlier]
        some = np.flatnonzero(differ <= (x + y) * (MATCH[1] - MATCH[0]) // (MATCH[0] + MATCH[1]))
        later, earlier, x, y, differ = later[some], earlier[some], x[some], y[some], differ[some]
        both = np.flatnonzero((x > ONE_WORD) & (y > ONE_WORD))
        a, b = later[both], earlier[both]
        high = self.high[a] ^ self.high[b]
        differ[both] = np.bitwise_count(high).astype(np.int64) + np.bitwise_count(self.low[a] ^ self.low[b] ^ high)
        need = least_overlap(x, y)
        able = np.minimum(x - self.pos[later], y - self.pos[earlier])
        fits = np.minimum(x, y) * MATCH[1] >= np.maximum(x, y) * MATCH[0]
        # The same line again: a key that it has twice by a rare collision, or a repeated row.
        ok = fits & (able >= need) & (differ <= x + y - 2 * need) & self.other(later, earlier)
        return some[ok], differ[ok]

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(self) else np.zeros(0, np.int64)
        return edge, np.diff(np.concatenate([edge, [len(self)]]))

    def candidates(self) -> pa.RecordBatch:
        """The best candidates of each line in each list. The rows are collapsed."""
        edge, length = self.lists()
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)]
        # By size: the partners of a line that follow it end at the first that is too large, or with the list.
        short = np.flatnonzero(np.repeat(length <= self.bounds.short, length))
        code = np.repeat(np.arange(len(edge)), length) << 32 | self.size
        last = np.searchsorted(code, code[short] - self.size[short] + self.size[short] * MATCH[1] // MATCH[0], "right")
        many, most = last - short - 1, np.minimum(self.size // MATCH[0], 255).astype(np.uint8)
        total = np.cumsum(many)
        at = 0
        while at < len(short):
            to = max(at + 1, int(np.searchsorted(total, total[at] - many[at] + PAIRS_AT_ONCE, "right")))
            row, step = _ramp(many[at:to])
            a = short[at:to][row]
            b = a + step + 1
            near = np.flatnonzero(np.bitwise_count(self.low[a] ^ self.low[b]) <= most[a])
            a, b = a[near], b[near]
            ok, differ = self.compare(a, b)
            a, b = a[ok], b[ok]
            swap = self.after(a, b)
            found.append((np.where(swap, a, b), np.where(swap, b, a), differ, np.zeros(len(ok), bool)))
            at = to
        long = np.flatnonzero(length > self.bounds.short)
        for start, size in zip(edge[long].tolist(), length[long].tolist(), strict=True):
            found += self.long(start + np.lexsort(self.name[::-1, start : start + size]))
        return self.best(found)

    def long(self, line: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Candidates in a long list, given in order: a block of lines is compared with ever later stretches.

        A line leaves once it has enough candidates, and ``more`` says that
        it did so early. So a list of near copies takes linear time.
        """
        found, side = [], self.bounds.side
        low, most = self.low[line], self.size[line] // MATCH[0]
        for at in range(0, len(line), side):
            rows = np.arange(at, min(at + side, len(line)))
            count = np.zeros(len(rows), np.int64)
            lo, end, span = 0, int(rows[-1]), 64
            while lo < end and len(rows):
                hi = min(end, lo + span)
                # The larger of two sets is 5 / 4 of the smaller at most, so they differ in a quarter of its size at most.
                far = np.bitwise_count(low[rows, None] ^ low[None, lo:hi])
                row, col = np.nonzero(far <= most[rows][:, None])
                before = lo + col < rows[row]
                row, b = row[before], lo + col[before]
                ok, differ = self.compare(line[rows[row]], line[b])
                row, b = row[ok], b[ok]
                count += np.bincount(row, minlength=len(rows))
                left = (count >= self.bounds.tries) & (hi < rows)
                found.append((line[rows[row]], line[b], differ, left[row]))
                rows, count = rows[~left], count[~left]
                lo, span = hi, min(4096, span * 4)
        return found

    def best(self, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """The best candidates of each row; ``more`` says that it has or may have others."""
        later, earlier, differ, more = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((earlier, differ, later))
        later, earlier, differ, more = later[order], earlier[order], differ[order], more[order]
        if len(later):
            first = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]]))
            count = np.diff(np.concatenate([first, [len(later)]]))
            more = np.repeat(np.maximum.reduceat(more, first) | (count > self.bounds.tries), count)
            kept = np.arange(len(later)) - np.repeat(first, count) < self.bounds.tries
            later, earlier, more = later[kept], earlier[kept], more[kept]
        mine = dict(zip(LINE, self.name[:, later], strict=True))
        others = {f"other_{n}": column for n, column in zip(LINE, self.name[:, earlier], strict=True)}
        return _found(**mine, **others, key=self.key[later], more=more)


def _earliest(order: np.ndarray, fresh: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For rows in an order where a group begins at each fresh one: the earliest row of each one's group."""
    group = np.cumsum(fresh) - 1
    many = np.flatnonzero((np.bincount(group) > 1)[group]) if len(order) else order
    first = order[fresh]
    rows = many[np.lexsort((*name[::-1, order[many]], group[many]))]
    begins = rows[np.concatenate([[True], group[rows[1:]] != group[rows[:-1]]])] if len(rows) else rows
    first[group[begins]] = order[begins]
    return first[group]


FOUND = pa.schema(
    [(f"{other}{n}", pa.int64()) for other in ("", "other_") for n in LINE]
    + [("key", pa.int64()), ("more", pa.bool_()), ("chunk", pa.int32()), ("rows", pa.binary())]
)
LINE_DDL = "id long, hash long, line long"
FOUND_DDL = f"{LINE_DDL}, other_id long, other_hash long, other_line long, key long, more boolean, chunk int, rows binary"


def _found(**columns) -> pa.RecordBatch:
    """Rows of FOUND; columns that aren't given are null."""
    n = len(columns["id"])
    arrays = [pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in FOUND]
    return pa.RecordBatch.from_arrays(arrays, schema=FOUND)


class Packer:
    """Gathers the listed lines of a task and packs them by bucket."""

    def __init__(self, buckets: int, frequent: int):
        self.buckets, self.frequent = buckets, frequent
        self.lines: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.count = self.size = 0

    def add(self, lines: Lines, name: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        low, high = lines.parities()
        key, row, pos, first = lines.keys(np.arange(len(lines)), self.frequent)
        self.lines.append(np.stack([*name, lines.signatures().view(np.int64), low.view(np.int64), high.view(np.int64), lines.size]))
        self.keys.append(np.stack([key, row + self.count, pos << 1 | first]))
        self.count += len(lines)
        self.size += len(key)

    def packed(self) -> pa.RecordBatch:
        """(bucket, rows), and from then on nothing is held."""
        lines, keys = np.concatenate(self.lines, 1), np.concatenate(self.keys, 1)
        self.lines, self.keys, self.count, self.size = [], [], 0, 0
        # Equal sets are settled here: all but the earliest leave.
        order = np.argsort(lines[3])
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any(lines[3:7, order[1:]] != lines[3:7, order[:-1]], axis=0)
        first = _earliest(order, fresh, lines[:3])
        gone = np.any(lines[:3, order] != lines[:3, first], axis=0)
        out = np.ones(len(order), bool)
        out[first[fresh]] = False
        settled = order[gone]
        keys = keys[:, ~out[keys[1]]]
        rows = np.zeros((Listed.WIDTH, keys.shape[1] + len(settled)), np.int64)
        n = keys.shape[1]
        rows[0, :n], rows[1:7, :n] = keys[0], lines[:6, keys[1]]
        rows[7, :n] = lines[6, keys[1]] << 32 | keys[2]
        rows[1:4, n:], rows[7, n:] = lines[:3, settled], -1
        spread = (lines[2, settled] + lines[1, settled]).view(np.uint64) * np.uint64(3) + lines[0, settled].view(np.uint64)
        rows[0, n:] = (_mix(spread, _BASE) >> np.uint64(16)).view(np.int64)
        bucket = rows[0] % self.buckets
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[:, order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if n + len(settled) else []
        packs = [rows[:, a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(packs, pa.binary())], ["bucket", "rows"])


def _unpacked(rows: bytes) -> np.ndarray:
    return np.frombuffer(rows, np.int64).reshape(Listed.WIDTH, -1)


def listed(docs: DataFrame, levels: np.ndarray, buckets: int, id_col: str, text_col: str, words: int, bounds: Bounds) -> DataFrame:
    """(bucket, rows): packed lines under their keys."""
    shipped = docs.sparkSession.sparkContext.broadcast(levels)
    frequent = frequent_level()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, frequent)
        for batch in batches:
            ids, hashes, base = _names(batch)
            for at, _, data, offsets in _parts(batch.column(3)):
                lines = Lines(data, offsets, shipped.value, words=words)
                if len(lines):
                    doc = lines.doc + at
                    packer.add(lines, (ids[doc], hashes[doc], base[doc] + lines.number))
                if packer.size >= bounds.rows:
                    yield packer.packed()
        if packer.size:
            yield packer.packed()

    return map_arrow(_rows(docs, id_col, text_col), run, "bucket int, rows binary")


class Bucket:
    """The lists of one bucket, as they come in. Hot lists are handed on in chunks, whatever their length."""

    def __init__(self, bounds: Bounds):
        self.bounds = bounds
        self.held: list[np.ndarray] = []
        self.size, self.limit = 0, bounds.rows
        self.chunks: dict[int, int] = {}

    def add(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        self.size += rows.shape[1]
        if self.size > self.limit:
            lists = yield from self._cooled()
            self.held, self.size = [lists.rows], len(lists)
            self.limit = max(self.bounds.rows, 2 * self.size)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            lists = yield from self._cooled()
            yield lists.candidates()

    def _cooled(self):
        """Collapse what is held, and hand on lists that are hot."""
        lists, settled = Listed(np.concatenate(self.held, 1), self.bounds).collapsed()
        if settled.shape[1]:
            yield _found(**dict(zip(LINE, settled, strict=True)))
        edge, length = lists.lists()
        cool = np.ones(len(lists), bool)
        for start, size in zip(edge.tolist(), length.tolist(), strict=True):
            key = int(lists.key[start])
            if size <= self.bounds.hot and key not in self.chunks:
                continue
            cool[start : start + size] = False
            for at in range(start, start + size, self.bounds.hot):
                number = self.chunks[key] = self.chunks.get(key, 0) + 1
                rows = lists.rows[:, at : min(at + self.bounds.hot, start + size)].tobytes()
                yield _found(id=[key], chunk=[number], rows=[rows])
        return Listed(lists.rows[:, cool], self.bounds) if not cool.all() else lists


def found_in_lists(rows: DataFrame, partitions: int, bounds: Bounds) -> DataFrame:
    """FOUND rows of the lists(bucket, rows).

    A candidate: a later line, an earlier one, their key, and whether there may be others under it.
    A settled line: no other. A chunk of a hot list: its key as id, its number
    and its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, Bucket(bounds)
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != at:
                    yield from bucket.end()
                    at, bucket = number, Bucket(bounds)
                yield from bucket.add(_unpacked(packed.as_buffer()))
        yield from bucket.end()

    placed = rows.repartitionById(partitions, F.pmod("bucket", F.lit(partitions))).sortWithinPartitions("bucket")
    return map_arrow(placed, run, FOUND_DDL)


def found_in_chunks(chunks: DataFrame, bounds: Bounds) -> DataFrame:
    """FOUND rows of the chunks(id, chunk, rows) of hot lists: each pair of chunks of a list meets in a task."""
    many = chunks.groupBy(F.col("id").alias("key")).agg(F.max("chunk").alias("n"))
    rows = chunks.join(many, F.col("id") == F.col("key"))
    # A pair of chunks joins each of them with itself as well.
    lower = F.when(F.col("n") == 1, F.array(F.lit(1))).otherwise(F.filter(F.sequence(F.lit(1), "n"), lambda k: k != F.col("chunk")))
    rows = rows.select("key", "chunk", "rows", F.explode(lower).alias("with"))
    rows = rows.select("key", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("other"), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                name = (row["key"], row["one"], row["other"])
                if name != at:
                    yield from join(held)
                    at, held = name, []
                held.append(_unpacked(row["rows"]))
        yield from join(held)

    def join(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        lists, settled = Listed(np.concatenate(held, 1), bounds).collapsed()
        if settled.shape[1]:
            yield _found(**dict(zip(LINE, settled, strict=True)))
        yield lists.candidates()

    placed = rows.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    return map_arrow(placed, run, FOUND_DDL)


def _bit(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = _mix(h * np.uint64(_BASE) + c.astype(np.uint64), 0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - PICK_BITS)).astype(np.int64)


def _filter(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit of each of the rows of longs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (PICK_BITS - 3), np.uint8)
        for batch in batches:
            bit = _bit(*(c.to_numpy() for c in batch.columns))
            np.bitwise_or.at(bitmap, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        words = bitmap.view(np.int64)
        some = np.flatnonzero(words)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(words[part])], ["word", "bits"])

    found = map_arrow(rows, mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (PICK_BITS - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint8)


def _hit(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _sets(docs: DataFrame, levels: np.ndarray, lines: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, hash, line, words) of at least the given lines(id, hash, line), rarest words first."""
    named = lines.select("id", "hash", _none(F.col("line")))
    shipped = docs.sparkSession.sparkContext.broadcast((levels, _filter(named), _filter(lines)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, documents, picked = shipped.value
        for batch in batches:
            batch = batch.filter(pa.array(_hit(documents, _bit(*(batch.column(k).to_numpy() for k in range(3))))))
            ids, hashes, base = _names(batch)
            for at, _, data, offsets in _parts(batch.column(3)):
                picks = lambda doc, number: _hit(picked, _bit(ids[doc + at], hashes[doc + at], base[doc + at] + number))  # noqa: B023, E731
                cut = Lines(data, offsets, level, picks, words)
                doc = cut.doc + at
                name = [pa.array(c) for c in (ids[doc], hashes[doc], base[doc] + cut.number)]
                yield pa.RecordBatch.from_arrays([*name, cut.sets(np.arange(len(cut)))], [*LINE, "words"])

    return map_arrow(_rows(docs, id_col, text_col), run, f"{LINE_DDL}, words array<long>")


def _under_keys(docs: DataFrame, levels: np.ndarray, keys: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(key, id, hash, line, size, low, high) of all lines under at least the given keys(key)."""
    shipped = docs.sparkSession.sparkContext.broadcast((levels, _filter(keys)))
    frequent = frequent_level()
    names = ["key", *LINE, "size", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, picked = shipped.value
        for batch in batches:
            ids, hashes, base = _names(batch)
            for at, _, data, offsets in _parts(batch.column(3)):
                cut = Lines(data, offsets, level, words=words)
                if not len(cut):
                    continue
                key, line, _, _ = cut.keys(np.arange(len(cut)), frequent)
                some = np.flatnonzero(_hit(picked, _bit(key)))
                key, line = key[some], line[some]
                low, high = cut.parities()
                doc = cut.doc[line] + at
                name = (ids[doc], hashes[doc], base[doc] + cut.number[line])
                columns = (key, *name, cut.size[line], low[line].view(np.int64), high[line].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return map_arrow(_rows(docs, id_col, text_col), run, f"key long, {LINE_DDL}, size long, low long, high long")


def _may_match() -> Column:
    """Condition on two lines of (size, low, high) and (size2, low2, high2): the length and parity filters."""
    top, bottom = MATCH
    low, high = F.col("low").bitwiseXOR(F.col("low2")), F.col("high").bitwiseXOR(F.col("high2"))
    both = F.col("size") + F.col("size2")
    large = (F.col("size") > ONE_WORD) & (F.col("size2") > ONE_WORD)
    differ = F.when(large, F.bit_count(high) + F.bit_count(low.bitwiseXOR(high))).otherwise(F.bit_count(low))
    most = both - 2 * F.ceil(top * both / (top + bottom))
    return (F.least("size", "size2") * bottom >= F.greatest("size", "size2") * top) & (differ <= most)


def _verified(rows: DataFrame) -> DataFrame:
    """(id, hash, line) of the rows(id, hash, line, w, ow) whose two sets match."""
    top, bottom = MATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(3), batch.column(4)):
                size = np.diff(column.offsets.to_numpy()).astype(np.int64)
                sides.append((size, np.repeat(np.arange(len(size)), size), column.flatten().to_numpy()))
            (x, row, hashes), (y, row2, hashes2) = sides
            row, hashes = np.concatenate([row, row2]), np.concatenate([hashes, hashes2])
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            same = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
            shared = np.bincount(row[1:][same], minlength=len(x))
            match = np.flatnonzero(shared * (top + bottom) >= top * (x + y))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[match]) for k in range(3)], LINE)

    return map_arrow(rows.select(*LINE, "w", "ow"), run, LINE_DDL)


def _matched(docs: DataFrame, levels: np.ndarray, pairs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Names of the lines of pairs(id, hash, line, other_id, other_hash, other_line) that match their other."""
    here, there = F.struct(*LINE), F.struct(*[F.col(f"other_{n}").alias(n) for n in LINE])
    sides = pairs.select(
        here.alias("here"), there.alias("there"), F.inline(F.array(*[F.struct(F.lit(k).alias("side"), line.alias("line")) for k, line in enumerate((here, there))]))
    )
    sides = sides.select("here", "there", "side", "line.*")
    sets = _sets(docs, levels, sides.select(*LINE), id_col, text_col, words)
    met = sides.join(sets, LINE)
    both = met.groupBy("here", "there").agg(
        F.first(F.when(F.col("side") == 0, F.col("words")), True).alias("w"), F.first(F.when(F.col("side") == 1, F.col("words")), True).alias("ow")
    )
    return _verified(both.select("here.*", "w", "ow"))


def _by_line(found: DataFrame) -> DataFrame:
    """(id, hash, line, settled, keys, others) of each line found: the lists that held more, and its candidates; chunks as they are."""
    other = F.col("other_id").isNotNull()
    return found.groupBy(*LINE, "chunk").agg(
        F.max(~other).alias("settled"),
        F.collect_set(F.when(F.col("more"), F.col("key"))).alias("keys"),
        F.collect_set(F.when(other, F.struct(*[f"other_{n}" for n in LINE]))).alias("others"),
        F.first("rows", True).alias("rows"),
    )


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 0, bounds: Bounds | None = None) -> DataFrame:
    """(id, hash, line) of every line that matches an earlier one.

    line: its number, and 1 << NONE_BIT more where the document has no id. With ``words`` a whole text is one line, and its shingles of so many words are what
    the sets hold.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = bounds or BOUNDS
    levels, n_words = word_levels(docs, text_col, words)
    # A line has at most about 0.4 times as many keys as words, so what a task holds doesn't depend on the session's settings.
    buckets = max(partitions * BUCKETS, 2 * n_words // (5 * BUCKET_ROWS) + 1)
    found = found_in_lists(listed(docs, levels, buckets, id_col, text_col, words, bounds), partitions, bounds)
    lines = checkpointed(_by_line(found))
    chunks = lines.where("rows IS NOT NULL").select("id", "chunk", "rows")
    if chunks.count():
        both = lines.where("rows IS NULL").unionByName(_by_line(found_in_chunks(chunks, bounds)))
        lines = checkpointed(
            both.groupBy(*LINE).agg(
                F.max("settled").alias("settled"),
                F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"),
                F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"),
            )
        )
    gone = lines.where("settled").select(*LINE)
    lines = lines.where("NOT settled")
    pairs = lines.select(*LINE, F.inline("others"))
    gone = checkpointed(gone.unionByName(_matched(docs, levels, pairs, id_col, text_col, words)).distinct())
    open_ = checkpointed(lines.where(F.size("keys") > 0).join(gone, LINE, "left_anti").select(*LINE, F.explode("keys").alias("key")))
    if not open_.count():
        return gone
    # What its best candidates leave open is compared with all lines of the lists that held more.
    listed_ = checkpointed(_under_keys(docs, levels, open_.select("key").distinct(), id_col, text_col, words).repartition("key"))
    others = listed_.withColumnsRenamed({"size": "size2", "low": "low2", "high": "high2", **{n: f"other_{n}" for n in LINE}})
    mine = listed_.join(open_, ["key", *LINE], "left_semi").dropDuplicates(["key", *LINE])
    earlier = F.struct(*[F.col(f"other_{n}").alias(n) for n in LINE]) < F.struct(*LINE)
    pairs = mine.join(others, (mine["key"] == others["key"]) & earlier & _may_match())
    pairs = checkpointed(pairs.select(*LINE, *[f"other_{n}" for n in LINE]).distinct())
    return gone.unionByName(_matched(docs, levels, pairs, id_col, text_col, words).distinct())


def _by_document(gone: DataFrame) -> DataFrame:
    """(id, hash, none, numbers) of the documents that lose lines."""
    return gone.groupBy("id", "hash", _none(F.col("line"))).agg(
        F.sort_array(F.collect_list(F.col("line").bitwiseAND((1 << NONE_BIT) - 1).cast("int"))).alias("numbers")
    )


#: From the first letter of a word to the end of its line.
_LINE = r"[^\x20\x09-\x0D][^\n]*"


def _line_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        *_name(id_col, text_col),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(text_col, F.lit(_LINE)), F.lit(0)).cast("long").alias("n_lines"),
    )
    return rows


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: Bounds | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every document; line numbers from 0."""
    by = _by_document(removed_lines(docs, id_col, text_col, bounds=bounds))
    joined = _line_counts(docs, id_col, text_col).join(by, ["id", "hash", "none"], "left")
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(numbers).cast("long").alias("n_removed"), numbers.alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: Bounds | None = None) -> DataFrame:
    """The documents without the removed lines, other columns as given.

    A document that loses all its lines stays, with what blank lines it had.
    """
    gone = removed_lines(docs, id_col, text_col, bounds=bounds)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_name(id_col, text_col))
    joined = rows.join(_by_document(gone), ["id", "hash", "none"], "left")
    lines = F.filter(F.split(F.col("row")[text_col], "\n"), lambda x, i: ~F.array_contains(F.col("numbers"), i))
    text = F.when(F.col("numbers").isNull(), F.col("row")[text_col]).otherwise(F.array_join(lines, "\n"))
    return joined.select(F.col("row").withField(text_col, text).alias("row")).select("row.*").select(*docs.columns)


def dedup_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, also: DataFrame | None = None, bounds: Bounds | None = None
) -> DataFrame:
    """The documents that match no earlier one, columns as given.

    Documents match if the sets of their shingles of ``words`` words do, by the
    same exact join as lines. A text with fewer words is one shingle, and texts
    without words match each other. Of rows that share id and text one stays.
    ``also``: (id, text_hash) of further rows that go, as ``simhash.copies``
    gives them.
    """
    gone = removed_lines(docs, id_col, text_col, words, bounds).select("id", "hash", _none(F.col("line")))
    if also is not None:
        hash_ = F.col("text_hash").bitwiseXOR(F.lit(SIGN)).alias("hash")
        gone = gone.unionByName(also.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), hash_, F.col("id").isNull().cast("long").alias("none")))
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(
        row.alias("row"),
        *_name(id_col, text_col),
        F.xxhash64(*[docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]).alias("order"),
    )
    name = ["id", "hash", "none"]
    kept = rows.join(gone, name, "left_anti")
    # Names are counted where they are read; only rows whose name occurs again are numbered, in parts first.
    again = checkpointed(docs.select(*_name(id_col, text_col)).groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*name))
    once, many = kept.join(again, name, "left_anti"), kept.join(again, name, "left_semi")
    many = many.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    for of in ([*name, "part"], name):
        many = many.withColumn("first", F.row_number().over(Window.partitionBy(*of).orderBy("order"))).where("first = 1")
    return once.select("row.*").unionByName(many.select("row.*"))
