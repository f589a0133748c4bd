"""Language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of hashed letter n-grams. The
training vectors of each language are clustered by spherical k-means, and a
text takes the language of the centroid with the largest cosine. A text whose
cosine lies below that centroid's limit, a low quantile of its own members, is
marked as rejected.

Document frequencies cover all documents that may be learned from; clustering
uses at most SAMPLE_ROWS of them, which every language shares alike, so that a
rare one is learned from as well. Whole texts are read.

Defined results: texts that are null or hold no letter are ``und`` with score
0, and so is everything when nothing can be learned. Rows with null ids are
judged like others, and held out if the checksum of an empty text says so;
they aren't learned from. Repeated rows are judged alike, an empty table gives
no rows, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import map_arrow
from ._fit import id_remainder, letters, sampled_texts

#: Documents that are clustered at most, about, as many of each language as of any other.
SAMPLE_ROWS = 4000
#: Hash buckets of n-grams, n-gram lengths in bytes, clusters of a language.
BUCKETS, LENGTHS, CLUSTERS = 4096, (2, 3, 4), 4
#: Share of a cluster's members that its limit lets go, and sharpness of the score.
REJECT_SHARE, SHARPNESS = 0.002, 30.0
#: Held-out rows: the crc32 of the id has this remainder.
FOLDS, HELD_OUT = 4, 2


@dataclass(frozen=True)
class CentroidModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts of a text's letter n-grams by hash bucket."""
    data = np.frombuffer(b" " + letters(text) + b" ", np.uint8)
    space = data == 0x20
    data = data[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint64)
    counts = np.zeros(BUCKETS, np.int64)
    for n in LENGTHS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[k : len(data) - n + 1 + k]
        slot = code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        counts += np.bincount(slot.astype(np.int64), minlength=BUCKETS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / (np.linalg.norm(v) or 1.0)


def _cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means from far-apart starts, and each row's cosine and cluster."""
    k = max(1, min(k, len(x) // 8))
    start = [int(np.argmax(x @ x.mean(0)))]
    while len(start) < k:
        start.append(int(np.argmin((x @ x[start].T).max(1))))
    centroids = x[start]
    for _ in range(20):
        mine = np.argmax(x @ centroids.T, 1)
        moved = np.stack([x[mine == j].mean(0) if np.any(mine == j) else centroids[j] for j in range(k)])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centroids, atol=1e-7):
            break
        centroids = moved
    return centroids, np.argmax(x @ centroids.T, 1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CentroidModel | None:
    """Learn from text and language of documents that aren't held out."""
    learn = docs.where(F.col(lang_col).isNotNull() & (id_remainder(F.col(id_col), FOLDS) != HELD_OUT))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += ngram_counts(text) > 0
                n += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(seen[some], n).astype(np.int64))],
            ["bucket", "n"],
        )

    df = map_arrow(learn.select(F.col(text_col).alias("text")), frequencies, "bucket int, n long")
    totals = {r["bucket"]: r["s"] for r in df.groupBy("bucket").agg(F.sum("n").alias("s")).collect()}
    if not totals.get(-1):
        return None
    idf = np.log((1 + totals[-1]) / (1 + np.array([totals.get(b, 0) for b in range(BUCKETS)], float))) + 0.1

    keys = learn.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(lang_col).alias("label"))
    sample = sampled_texts(learn, keys, id_col, text_col, SAMPLE_ROWS).select(F.col("label").alias("lang"), "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [weighted(ngram_counts(t), idf).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary())], ["lang", "v"])

    rows = sorted((r["lang"], bytes(r["v"])) for r in map_arrow(sample, vectors, "lang string, v binary").collect())
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not languages:
        return None
    centroids, owner, limits = [], [], []
    for i, language in enumerate(languages):
        x = np.stack([np.frombuffer(v, np.float32) for lang, v in rows if lang == language])
        found, mine = _cluster(x, CLUSTERS)
        for j, centroid in enumerate(found):
            members = x[mine == j] @ centroid
            centroids.append(centroid)
            owner.append(i)
            limits.append(float(np.quantile(members, REJECT_SHARE)) if len(members) else 1.0)
    return CentroidModel(languages, idf, np.stack(centroids), np.array(owner), np.array(limits))


def judge(text: str | None, model: CentroidModel | None) -> tuple[str, float, bool]:
    """(language, score, rejected) of a text."""
    if model is None or not text or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    cosines = model.centroids @ weighted(ngram_counts(text), model.idf)
    best = int(np.argmax(cosines))
    each = np.full(len(model.languages), -1.0)
    np.maximum.at(each, model.owner, cosines)
    share = np.exp(SHARPNESS * (each - each.max()))
    return model.languages[model.owner[best]], float(share.max() / share.sum()), bool(cosines[best] < model.limits[best])


def predict(docs: DataFrame, model: CentroidModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t, shipped.value) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select(
        "doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected"
    )
