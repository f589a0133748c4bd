"""Bounded labelled samples and small linear models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed

#: Grain of the hash by which rows are sampled.
_GRAIN = 1 << 40


def id_remainder(id_: Column, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; a null id counts as no text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def sampled_texts(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, bound: int) -> DataFrame:
    """(id, label, text, weight) of about ``bound`` rows at most, as many of each label as of any other.

    labelled(id, hash, label) names rows of docs by their id and the hash of
    their text, so neither an id nor a text that occurs again and again
    multiplies rows: each (id, text, label) counts once, and a label that has
    few keeps all of them. weight: how many rows a sampled one stands for. The
    number of labels is taken to be small; what is broadcast is the sample's
    ids and hashes, of about ``bound`` rows.
    """
    known = checkpointed(labelled.where(F.col("id").isNotNull() & F.col("label").isNotNull()).distinct())
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(max(1, bound // max(1, sizes.count())))
    sizes = sizes.select(F.col("label").alias("_label"), F.greatest(F.lit(1.0), F.col("n") / share).alias("weight"))
    place = F.pmod(F.xxhash64("id", "hash"), F.lit(_GRAIN))
    chosen = known.join(F.broadcast(sizes), F.col("label") == F.col("_label")).where(place < F.lit(_GRAIN) / F.col("weight"))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    same = (F.col("id") == F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return rows.join(F.broadcast(chosen), same).groupBy("id", "hash", "label").agg(F.first("text").alias("text"), F.first("weight").alias("weight")).drop("hash")


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """labels(id, label) with the hash of each text that has the id."""
    known = labels.select(F.col(id_col).alias("id"), "label").distinct()
    keys = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("hash")).distinct()
    return keys.join(known, F.col("_id") == F.col("id")).select("id", "hash", "label")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic model, by Newton steps.

    ``weight``: what each row counts for; only their proportions matter.
    """
    counts = np.ones(len(x)) if weight is None else weight * (len(x) / weight.sum())
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (counts * (p - y)) + penalty * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


#: Lower-cased bytes with ASCII other than letters as spaces.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def letters(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(LETTERS)
