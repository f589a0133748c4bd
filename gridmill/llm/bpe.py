"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves of a segment tree that holds, for each symbol,
the rank of the merge with its right neighbour. The root yields the leftmost
merge of lowest rank; a merge changes three leaves and their paths, so a word
of m symbols takes O(m log m). Trees of words of like length are kept as rows
of one array and merged side by side. A long word's tree is merged rank by
rank, all merges of the root's rank at once.

The tokenizer file is read on the driver and shipped once; it is a fixed file,
not data. Each word is encoded once per worker and batch group: a bounded cache
maps words to their tokens.

Defined results: a null text encodes as the empty one, with no tokens and an
empty decoding. Texts and words of any length are encoded whole. Repeated rows
are encoded alike, an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import map_arrow

#: Words in a worker's cache; beyond that it starts anew, with what is still in use of as many words before.
CACHE_WORDS = 125_000
#: Leaves in the trees that are merged side by side, and in the largest of these; a longer word is merged alone.
LEAVES_AT_ONCE, LONG_WORD = 1 << 20, 256

_NONE = np.int64(np.iinfo(np.int64).max)
#: The white space of Unicode.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_NOT_SPACE = re.compile(f"[^{_SPACE}]+")
#: Characters that str.split() takes for white space though Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Vocabulary:
    """Merges, names and special tokens of a tokenizer file, as tables."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.names = [""] * (max([*ids.values(), *[t["id"] for t in spec["added_tokens"]]]) + 1)
        for name, i in ids.items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.names[i] = name
        self.is_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.suffix: str = model["end_of_word_suffix"] or ""
        pieces = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(pieces[0].replace(r"\s", _SPACE))
        chars = _byte_names()
        self.byte_ids = np.array([ids[c] for c in chars], np.int64)
        self.last_ids = np.array([ids[c + self.suffix] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self._index(left * len(self.names) + right)
        # A merge makes a symbol; where no pair with that symbol comes before the merge itself, as is usual, all
        # merges of one rank that don't touch can be done at once: none of them makes way for an earlier one.
        first_use = np.full(len(self.names), len(merges))
        np.minimum.at(first_use, left, np.arange(len(merges)))
        np.minimum.at(first_use, right, np.arange(len(merges)))
        self.at_once = first_use[self.made] > np.arange(len(merges)) if len(merges) else np.zeros(0, bool)

    def _index(self, pairs: np.ndarray) -> None:
        """An open-addressing table from pair to rank; of equal pairs the last counts."""
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int64)
        for rank, pair in enumerate(pairs.tolist()):
            at = self._slot(pair)
            while self.slots[at] not in (-1, pair):
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at], self.ranks[at] = pair, rank

    def _slot(self, pair: int) -> int:
        return (pair * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge; a side below 0 is no symbol."""
        pair = left * len(self.names) + right
        at = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[at]
        rank = np.where(found == pair, self.ranks[at], -1)
        open_ = np.flatnonzero((found != pair) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found = self.slots[at[open_]]
            hit = found == pair[open_]
            rank[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return np.where((left < 0) | (right < 0), -1, rank)

    def split(self, word: str) -> list[str]:
        """Normalised pieces of a word without white space."""
        if not word.isascii():
            # Letter by letter: str.lower() would write a final sigma by context.
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        word = word.lower()
        return [word] if word.isascii() and word.isalpha() else self.pieces.findall(word)

    def encode(self, pieces: list[str]) -> list[tuple[bytes, str]]:
        """Token ids of each piece as 32-bit integers, and their names with a space between: the file names no decoder."""
        raw = [p.encode() for p in pieces]
        width = np.array([1 << max(1, (len(b) - 1).bit_length()) for b in raw])
        out = [(b"", "")] * len(raw)
        names = self.names

        def put(places: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
            data, said, at = ids.tobytes(), [names[i] for i in ids.tolist()], 0
            for place, to in zip(places, np.cumsum(counts).tolist(), strict=True):
                out[place] = (data[4 * at : 4 * to], " ".join(said[at:to]))
                at = to

        for i in np.flatnonzero(width > LONG_WORD).tolist():
            ids = self._merge_long(raw[i], int(width[i]))
            put([i], ids, np.array([len(ids)]))
        for w in np.unique(width[width <= LONG_WORD]).tolist():
            same = np.flatnonzero(width == w).tolist()
            step = max(1, LEAVES_AT_ONCE // w)
            for at in range(0, len(same), step):
                some = same[at : at + step]
                put(some, *self._merge([raw[i] for i in some], w))
        return out

    def _merge(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of at most ``width`` bytes, one segment tree a word: all their ids, and how many each has."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        symbols = np.where(place < lengths[:, None], self.byte_ids[flat], -1)
        rows = np.arange(n)
        symbols[rows, lengths - 1] = self.last_ids[flat[rows, lengths - 1]]
        # One more column at either end: no neighbour.
        after = np.where(place + 1 < lengths[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        padded = np.full((n, width + 1), -1, np.int64)
        padded[:, :width] = symbols
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self.rank(padded[:, :-1].ravel(), padded[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(rank < 0, _NONE, rank << 32 | place)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            at, made = root & 0xFFFFFFFF, self.made[root >> 32]
            gone = after[rows, at]
            then, prior = after[rows, gone], before[rows, at]
            padded[rows, at] = made
            padded[rows, gone] = -1
            after[rows, at] = then
            inner = then < width
            before[rows[inner], then[inner]] = at[inner]
            self._set(tree, rows, at, self.rank(made, padded[rows, then]), width)
            tree[rows, width + gone] = _NONE
            has = prior >= 0
            r, p = rows[has], prior[has]
            self._set(tree, r, p, self.rank(padded[r, p], made[has]), width)
            self._lift(tree, rows, at, width)
            self._lift(tree, rows, gone, width)
            self._lift(tree, r, p, width)
            rows = rows[tree[rows, 1] != _NONE]
        kept = padded[:, :width] >= 0
        return padded[:, :width][kept].astype(np.int32), kept.sum(1)

    def _merge_long(self, word: bytes, width: int) -> np.ndarray:
        """Merge one long word: in its tree, all merges of the lowest rank that don't touch, the leftmost first."""
        n, flat = len(word), np.frombuffer(word, np.uint8)
        symbols = np.full(width + 1, -1, np.int64)  # one more: no neighbour
        symbols[:n] = self.byte_ids[flat]
        symbols[n - 1] = self.last_ids[flat[-1]]
        place = np.arange(width)
        after, before = np.where(place + 1 < n, place + 1, width), place - 1
        tree = np.full(2 * width, _NONE, np.int64)
        rank = self.rank(symbols[:-1], symbols[1:])
        tree[width:] = np.where(rank < 0, _NONE, rank << 32 | place)
        for node in range(width.bit_length() - 2, -1, -1):
            level = np.arange(1 << node, 2 << node)
            tree[level] = np.minimum(tree[2 * level], tree[2 * level + 1])
        while tree[1] != _NONE:
            rank = int(tree[1] >> 32)
            at = self._lowest(tree, rank, width) if self.at_once[rank] else np.array([tree[1] & 0xFFFFFFFF])
            if len(at) > 1:  # of merges that touch, every other one, from the left
                run = np.flatnonzero(np.concatenate([[True], after[at[:-1]] != at[1:]]))
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = after[at]
            symbols[at], symbols[gone] = self.made[rank], -1
            after[at] = after[gone]
            inner = after[at] < width
            before[after[at][inner]] = at[inner]
            prior = before[at]
            near = np.unique(np.concatenate([at, prior[prior >= 0]]))
            fresh = self.rank(symbols[near], symbols[after[near]])
            tree[width + near] = np.where(fresh < 0, _NONE, fresh << 32 | near)
            tree[width + gone] = _NONE
            node = np.unique(np.concatenate([near, gone]) + width)
            while node[0] > 1:
                node = np.unique(node >> 1)
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
        return symbols[symbols >= 0].astype(np.int32)

    @staticmethod
    def _lowest(tree: np.ndarray, rank: int, width: int) -> np.ndarray:
        """Places of all leaves of a rank, from the root down along the nodes that have it."""
        node = np.array([1])
        while node[0] < width:
            node = np.stack([2 * node, 2 * node + 1], 1).ravel()
            node = node[tree[node] >> 32 == rank]
        return node - width

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, width: int) -> None:
        tree[rows, width + at] = np.where(rank < 0, _NONE, rank << 32 | at)

    @staticmethod
    def _lift(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, width: int) -> None:
        node = (width + at) >> 1
        while width > 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node, width = node >> 1, width >> 1


def _byte_names() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes and decodes texts, with a bounded cache of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        #: Words of late, and those before them, from which a word in use is taken over.
        self.words: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}

    def _words(self, text: str) -> list[str]:
        return _NOT_SPACE.findall(text) if _SEPARATORS.search(text) else text.split()

    def _parts(self, text: str) -> list[str]:
        """The text's words, special tokens among them as they are."""
        v = self.vocabulary
        if v.is_special is None or not v.is_special.search(text):
            return self._words(text)
        return [w for part in v.is_special.split(text) for w in ([part] if part in v.special else self._words(part))]

    def learn(self, parts: list[list[str]]) -> None:
        """Put what is new in the cache."""
        if len(self.words) > CACHE_WORDS:
            self.before, self.words = self.words, {}
        words, before, v = self.words, self.before, self.vocabulary
        missing = set().union(*parts).difference(words)
        again = missing.intersection(before)
        words.update([(w, before[w]) for w in again])
        new = list(missing.difference(again))
        split = [[] if w in v.special else v.split(w) for w in new]
        pieces = list(dict.fromkeys([p for s in split for p in s]))
        known = dict(zip(pieces, v.encode(pieces), strict=True))
        for word, of in zip(new, split, strict=True):
            if len(of) == 1:
                words[word] = known[of[0]]
            elif word in v.special:
                words[word] = (np.array([v.special[word]], np.int32).tobytes(), word)
            else:
                words[word] = (b"".join([known[p][0] for p in of]), " ".join([known[p][1] for p in of]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as 32-bit integers, and their decoding, of each text."""
        parts = [self._parts(t) for t in texts]
        self.learn(parts)
        words, out = self.words, []
        for part in parts:
            found = [words[w] for w in part]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        return out


@contextmanager
def _uncollected() -> Iterator[None]:
    """No cyclic collections: they would walk the whole cache again and again, and nothing in it is part of a cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_ENCODERS: dict[int, Encoder] = {}


def _encoder(source: str) -> Encoder:
    """This worker's encoder; workers serve several tasks."""
    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(source))
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every document, without a shuffle."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        with _uncollected():
            yield from encoded(encoder, batches)

    def encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                done = encoder.encode([t or "" for t in some.column(1).to_pylist()])
                ends = np.cumsum([0, *[len(ids) // 4 for ids, _ in done]]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join([ids for ids, _ in done]), np.int32), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(ends), values)
                decoded = pa.array([text for _, text in done], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0).cast(id_type), ids, decoded], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, ids array<int>, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """One row per document: its number of tokens and SHA-256 of ids and decoding."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
