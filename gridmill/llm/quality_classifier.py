"""Quality by compression: two zstandard dictionaries and a calibrated score.

One dictionary is built from texts labelled good, one from texts labelled bad.
A text is cut into short chunks, each compressed with both. The difference of
the summed sizes over their sum is the only feature; a logistic curve fitted on
labelled texts that no dictionary has seen turns it into a score.

The fit uses about SAMPLE_ROWS labelled documents at most, whole, and weighs
either label by the rows that it stands for. Dictionaries are trained on the
driver, on documents of SAMPLE_BYTES a label at most; one that doesn't fit is
passed over. Whole texts are scored.

Defined results: null and empty texts have difference 0 and get the score at
that point; without labels of both kinds every score is the share of good ones
(0.5 without any). Labels of null ids are not learned from; documents with null
ids are scored like others, and are held out if the checksum of an empty text
says so. Repeated rows are scored alike, documents that repeat an id are scored
one by one, an empty table gives no rows, extra columns are ignored or kept by
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed, map_arrow
from ._fit import apply_logistic, fit_logistic, id_remainder, labelled_rows, sampled_texts

#: Labelled documents that a fit uses at most, about, half of them of either label.
SAMPLE_ROWS = 4000
#: Bytes of whole texts of each label from which a dictionary is trained, at most.
SAMPLE_BYTES = 32 << 20
#: Bytes of a chunk and of a dictionary.
CHUNK, DICTIONARY = 512, 65536
#: Held-out rows: the crc32 of the id has this remainder.
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    scale: tuple[float, float]
    weights: tuple[float, ...]
    prior: float


class Meter:
    """Measures texts against a model's dictionaries."""

    def __init__(self, model: CompressionModel):
        self.model = model
        self.compressors = [self._compressor(d) for d in (model.good, model.bad)] if model.good and model.bad else []

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=1)
        return zstandard.ZstdCompressor(
            level=1, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def difference(self, text: bytes | None) -> float:
        """Above 0 if the text lies nearer to the good texts."""
        if not text or not self.compressors:
            return 0.0
        chunks = _chunks(text)
        good, bad = (sum([len(c.compress(x)) for x in chunks]) for c in self.compressors)
        return (bad - good) / (bad + good)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        m = self.model
        if not self.compressors or not m.weights:
            return np.full(len(texts), m.prior)
        x = np.array([self.difference(t) for t in texts])
        return apply_logistic(((x - m.scale[0]) / m.scale[1])[:, None], np.array(m.weights))


def _dictionary(chunks: list[bytes]) -> bytes:
    """A trained dictionary, or the chunks themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-DICTIONARY:]


def _chunks(text: bytes) -> list[bytes]:
    return [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]


def _within(budget: int, sizes: list) -> list[int]:
    """Places of the rows(label, place, bytes) whose texts fit, whole, into a budget for each label; a row that doesn't is passed over."""
    left: dict[int, int] = {}
    places = []
    for label, place, size in sorted(sizes):
        if size <= left.setdefault(label, budget):
            left[label] -= size
            places.append(place)
    return places


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CompressionModel:
    """Learn from labels (id, 0 or 1) of rows that aren't held out."""
    usable = labels.where((id_remainder(F.col(id_col), FOLDS) != HELD_OUT) & F.col(label_col).isin(0, 1))
    rows = labelled_rows(docs, usable.select(id_col, F.col(label_col).cast("int").alias("label")), id_col, text_col)
    known = sampled_texts(docs, rows, id_col, text_col, SAMPLE_ROWS)
    part = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(5)) < 3
    text = F.coalesce("text", F.lit("")).cast("binary")
    known = checkpointed(known.select("label", text.alias("text"), "weight", part.alias("for_dictionary"), F.xxhash64("id", "text").alias("place")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [_chunks(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(chunks, pa.list_(pa.binary()))], ["label", "weight", "chunks"])

    chosen = known.where("for_dictionary")
    sizes = chosen.select("label", "place", F.octet_length("text").alias("bytes")).collect()  # SAMPLE_ROWS narrow rows at most
    chosen = chosen.where(F.col("place").isin(_within(SAMPLE_BYTES, sizes)))
    rows = map_arrow(chosen, cut, "label int, weight double, chunks array<binary>").collect()
    rows.sort(key=lambda r: (r["label"], [bytes(c) for c in r["chunks"]]))  # the fit mustn't hang on the order of tasks
    kinds = [[bytes(c) for r in rows if r["label"] == kind for c in r["chunks"]] for kind in (0, 1)]
    prior = float(np.average([r["label"] for r in rows], weights=[r["weight"] for r in rows])) if rows else 0.5
    if not all(kinds):
        return CompressionModel(b"", b"", (0.0, 1.0), (), prior)
    model = CompressionModel(_dictionary(kinds[1]), _dictionary(kinds[0]), (0.0, 1.0), (), prior)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(shipped.value)
        for batch in batches:
            x = [meter.difference(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64()), batch.column(2)], ["label", "x", "weight"])

    measured = map_arrow(known.where("NOT for_dictionary"), measure, "label int, x double, weight double").collect()
    seen = sorted((r["x"], r["label"], r["weight"]) for r in measured)
    x, y, weight = (np.array([s[k] for s in seen]) for k in range(3))
    if len(set(y.tolist())) < 2:
        return model
    scale = (float(x.mean()), float(x.std()) or 1.0)
    weights = fit_logistic(((x - scale[0]) / scale[1])[:, None], y, ridge=1e-2, weight=weight)
    return CompressionModel(model.good, model.bad, scale, tuple(weights.tolist()), prior)


def _scored(rows: DataFrame, model: CompressionModel, schema: str) -> DataFrame:
    """Rows (text as binary first) with the text replaced by its score."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(shipped.value)
        for batch in batches:
            scores = pa.array(meter.score(batch.column(0).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([scores, *batch.columns[1:]], ["score", *batch.schema.names[1:]])

    return map_arrow(rows, run, schema)


def score_documents(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    scored = _scored(rows, model, "score double, doc_id long")
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, columns as given."""
    row = F.struct(*[docs[c] for c in docs.columns])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(shipped.value)
        for batch in batches:
            texts = batch.column(0).field(text_col).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(meter.score(texts) >= 0.5))

    packed = docs.select(row.alias("row"))
    return map_arrow(packed, run, packed.schema).select("row.*")
