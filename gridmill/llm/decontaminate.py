"""Benchmark decontamination by winnowed fingerprints.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Of
every ``window - gram + 1`` consecutive grams of ``gram`` words the one with the
least hash is kept (the last of equals), in training texts and test items alike.
Two texts that share ``window`` words share a kept gram there, so joining the
kept grams finds every shared span of that length. A hit is extended word by
word on both sides, over the words that were kept beside the gram; as each
window of a longer span has a kept gram of its own, that is as far as one hit
has to look. Words are compared, not hashes, so nothing is found that isn't there.

Items of fewer words than a window are found whole: for each such length all
grams of that many words are fingerprints.

What a task broadcasts is a bitmap of fixed size (FILTER_BITS) by which texts
leave out grams that no item has; a bit set by chance costs time only. Texts are
known by their SHA-256, so copies are joined once, however many there are.

Defined results: a null text or one without words has no hits; texts of any
length are searched whole; items without words match nothing; items that share
an id count as one, and null ids count as one item with an empty name. Repeated
rows each get their row. Without documents there are no rows, without items no
hits. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import map_arrow, stored
from .line_dedup import BYTES_AT_ONCE, _mix, _parts, _powers

#: Bits of the bitmap that picks grams, as a power of two.
FILTER_BITS = 25

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(256)])
_BASE, _STIR, _LAST = 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, np.uint64((1 << 64) - 1)

_FOUND = pa.list_(
    pa.struct(
        [("at", pa.int64()), ("words", pa.int32()), ("hash", pa.int64()), ("gram", pa.binary()), ("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))]
    )
)
_FOUND_DDL = "array<struct<at: bigint, words: int, hash: bigint, gram: binary, before: array<binary>, after: array<binary>>>"


@dataclass(frozen=True)
class Winnowing:
    """Shared spans of ``window`` words are surely found, by grams of ``gram`` words."""

    window: int = 10
    gram: int = 5

    @property
    def beside(self) -> int:
        """Words beside a gram that a window around it can reach."""
        return self.window - self.gram


class Words:
    """The words of texts laid end to end: hashes, documents, places in the lower-cased bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        word = _WORD[self.data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True  # texts don't run into each other
        self.start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | fresh[:-1]))
        self.end = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | fresh[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.count) - self.count
        self.hashes = np.concatenate([np.empty(0, np.uint64), *self._hashed()])

    def _hashed(self) -> Iterator[np.ndarray]:
        """Word hashes, a bounded number of bytes at a time, or one word."""
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + BYTES_AT_ONCE, "right")))
            here = self.data[self.start[at] : self.end[to - 1]]
            powers, inverses = _powers(len(here))
            sums = np.zeros(len(here) + 1, np.uint64)
            np.cumsum((here.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
            start, end = self.start[at:to] - self.start[at], self.end[at:to] - self.start[at]
            yield _mix((sums[end] - sums[start]) * inverses[start], _STIR)
            at = to

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the gram that begins at each word, and whether it lies in one text."""
        n = max(0, len(self.hashes) - length + 1)
        out = np.full(n, length, np.uint64)
        for k in range(length):
            out = _mix(out * np.uint64(_BASE) + self.hashes[k : k + n], _STIR)
        return out, self.doc[:n] == self.doc[length - 1 : length - 1 + n]

    def kept(self, how: Winnowing) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the grams that winnowing keeps."""
        hashes, inside = self.grams(how.gram)
        hashes = np.where(inside, hashes, _LAST)
        n = max(0, len(self.hashes) - how.window + 1)
        least, place = hashes[:n].copy(), np.arange(n)
        for k in range(1, how.beside + 1):
            here = hashes[k : k + n]
            fewer = here <= least
            place[fewer] = np.flatnonzero(fewer) + k
            least = np.minimum(least, here)
        whole = self.doc[:n] == self.doc[how.window - 1 : how.window - 1 + n]
        place = np.unique(place[whole])
        return place, hashes[place]

    def text(self, at: int) -> bytes:
        return self.data[self.start[at] : self.end[at]].tobytes()

    def found(self, at: int, length: int, hash_: int, beside: int) -> dict:
        doc = self.doc[at]
        low, high = self.first[doc], self.first[doc] + self.count[doc]
        return {
            "at": at - low,
            "words": length,
            "hash": hash_,
            "gram": b" ".join(self.text(k) for k in range(at, at + length)),
            "before": [self.text(k) for k in range(at - 1, max(low, at - beside) - 1, -1)],
            "after": [self.text(k) for k in range(at + length, min(high, at + length + beside))],
        }


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def fingerprints(texts: DataFrame, id_col: str, text_col: str, how: Winnowing, short: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """(id, n_words, key, found) of each text; key is null where nothing was found.

    For items (short is None) the fingerprints are all kept grams, or the whole
    item where it is short; for documents those that the bitmap knows, and the
    grams of the lengths in ``short``.
    """

    def prints(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        place, hashes = words.kept(how)
        yield place, hashes, how.gram, how.beside
        for length in range(1, how.window) if short is None else short:
            hashes, inside = words.grams(length)
            if short is None:
                inside &= words.count[words.doc[: len(hashes)]] == length
            place = np.flatnonzero(inside)
            yield place, hashes[place], length, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in _parts(batch.column(1)):
                words = Words(data, offsets)
                found: list[list[dict] | None] = [None] * (last - first)
                for place, hashes, length, beside in prints(words):
                    hashes = _mix(hashes ^ np.uint64(length * 2 + (beside == 0)), _BASE)  # short items have fingerprints of their own
                    if bitmap is not None:
                        bit = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        known = (bitmap[bit >> 6] >> (bit & 63)) & 1 == 1
                        place, hashes = place[known], hashes[known]
                    for at, hash_ in zip(place.tolist(), _signed(hashes).tolist(), strict=True):
                        doc = words.doc[at]
                        found[doc] = found[doc] or []
                        found[doc].append(words.found(at, length, hash_, beside))
                keys = [f and hashlib.sha256(data[offsets[k] : offsets[k + 1]]).digest() for k, f in enumerate(found)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(words.count), pa.array(keys, pa.binary()), pa.array(found, _FOUND)],
                    ["id", "n_words", "key", "found"],
                )

    id_type = texts.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    chosen = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(chosen, run, f"id {id_type}, n_words bigint, key binary, found {_FOUND_DDL}")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """The fingerprints' bits: at most 2^FILTER_BITS, however many items there are."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    mask = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 AS INT))")
    rows = prints.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(mask).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _alike(mine: Column, theirs: Column, most: int) -> Column:
    """How many words two lists share from their first one on."""
    out = F.lit(most)
    for k in reversed(range(most)):
        same = F.coalesce(F.get(mine, F.lit(k)) == F.get(theirs, F.lit(k)), F.lit(False))
        out = F.when(same, out).otherwise(k)
    return out


def _fitted(docs: DataFrame, items: DataFrame, how: Winnowing, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, n_words, key) of every document, and (key, item, first, last) of every span that a text shares with an item."""
    of_items = fingerprints(items, item_col, item_text_col, how, None, None).where("key IS NOT NULL")
    prints = stored(of_items.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), F.inline("found")).drop("at").distinct())
    short = sorted(r["words"] for r in prints.where((F.size("before") == 0) & (F.size("after") == 0)).select("words").distinct().collect() if r["words"] < how.window)
    rows = stored(fingerprints(docs, id_col, text_col, how, short, _bitmap(prints)))
    # Copies of a text have the same fingerprints: one of them is joined.
    texts = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("found").alias("found")).select("key", F.inline("found"))
    theirs = prints.withColumnsRenamed({"before": "_before", "after": "_after"})
    pairs = texts.join(theirs, ["hash", "words", "gram"]).withColumns(
        {"left": _alike(F.col("before"), F.col("_before"), how.beside), "right": _alike(F.col("after"), F.col("_after"), how.beside)}
    )
    whole = (F.size("_before") == 0) & (F.size("_after") == 0)
    hits = pairs.where((F.col("left") + F.col("words") + F.col("right") >= how.window) | whole).select(
        "key",
        "item",
        F.when(whole, F.col("at")).otherwise(F.col("at") - F.col("left")).alias("first"),
        F.when(whole, F.col("at") + F.col("words") - 1).otherwise(F.col("at") + F.col("words") + F.col("right") - 1).alias("last"),
    )
    return rows.select("id", "n_words", "key"), stored(hits.distinct())


def matched_spans(
    docs: DataFrame, items: DataFrame, how: Winnowing | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id_col, item, first, last): stretches of words, counted from 0, that a document shares with an item; stretches of one item may overlap."""
    rows, hits = _fitted(docs, items, how or Winnowing(), id_col, text_col, item_col, item_text_col)
    return rows.where("key IS NOT NULL").join(hits, "key").select(F.col("id").alias(id_col), "item", "first", "last")


def contamination_report(
    docs: DataFrame, items: DataFrame, how: Winnowing | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    rows, hits = _fitted(docs, items, how or Winnowing(), id_col, text_col, item_col, item_text_col)
    words = hits.select("key", F.explode(F.sequence("first", "last")).alias("word")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    texts = words.join(named, "key")
    none = F.array().cast("array<string>")
    clean = rows.where("key IS NULL").select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    hit = rows.where("key IS NOT NULL").join(texts, "key", "left")
    hit = hit.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return clean.unionByName(hit).select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, how: Winnowing | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that share no window with an item, all columns untouched."""
    texts = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    _, hits = _fitted(texts, items, how or Winnowing(), "id", "text", item_col, item_text_col)
    key = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    return docs.join(hits.select(F.col("key").alias("_hit")).distinct(), key == F.col("_hit"), "left_anti")
