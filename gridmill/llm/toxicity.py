"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Each link is a logistic model over
word features and the probabilities of the categories before it. In training
those come from models that haven't seen the row (out-of-fold), so a link
learns from predictions as good as those that it will get.

The categories are columns of the labelled table. A link's features are words
and word beginnings that mark its own category, chosen by how much more often
they occur in its documents: for each fold from the other folds alone, so that
what a fold's models are judged by has no part in them. Fitting uses about
SAMPLE_ROWS labelled documents at most; whole texts are scored.

Defined results: null, empty and letterless texts have no feature and get the
intercepts' probabilities; a category without both kinds of labels has its
share as its probability (0 without labels). A row counts as labelled where it
has the last category's label; a missing label of an earlier one counts as 0.
Labels of null ids aren't learned from; documents with null ids are scored like
others. Repeated rows are scored alike and learned from once; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed, map_arrow
from ._fit import apply_logistic, fit_logistic, labelled_rows, letters, sampled_texts

#: Labelled documents that a fit uses at most, about.
SAMPLE_ROWS = 12_000
#: Features of a link, fewest marked documents of a feature, folds of the chain.
FEATURES, MIN_DOCUMENTS, FOLDS = 400, 3, 5
#: Lengths of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)
#: Categories in the chain's order, as conditions on the labelled table. Low quality comes first, as the
#: table has no finer toxicity label than the one that the chain ends with.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def features(text: str | None) -> set[bytes]:
    """A text's words, and beginnings of longer words with a hyphen."""
    words = set(letters(text).split())
    found = set(words)
    for n in BEGINNINGS:
        found.update([w[:n] + b"-" for w in words if len(w) > n])
    return found


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    index: dict[bytes, int]
    weights: tuple[np.ndarray, ...]
    #: Share of the labelled rows whose last category is predicted by models that haven't seen them, with its rows.
    unseen_right: float = 0.0
    unseen_rows: int = 0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per category, in the chain's order."""
        p = np.zeros((len(x), 0))
        for w in self.weights:
            p = np.hstack([p, apply_logistic(np.hstack([x, p]), w)[:, None]])
        return p

    def matrix(self, found: list[list[int]], kind: type = float) -> np.ndarray:
        x = np.zeros((len(found), len(self.index)), kind)
        for i, some in enumerate(found):
            x[i, some] = 1
        return x

    def hits(self, text: str | None) -> list[int]:
        return [self.index[f] for f in self.index.keys() & features(text)]


def _link(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        w = np.zeros(x.shape[1] + 1)
        w[-1] = np.log((share + 1e-9) / (1 - share + 1e-9))
        return w
    return fit_logistic(x, y, ridge=0.3, weight=weight)


def fit_chain(
    x: np.ndarray, labels: np.ndarray, folds: np.ndarray, weight: np.ndarray, columns: Sequence[dict[int, list[int]]] | None = None
) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Weights of each link, and the out-of-fold probabilities; ``labels`` has a column per category, in order.

    columns: for each link the columns of x that models without a fold may use,
    and under -1 those of the final one; all of them where it isn't given. A
    link has weight 0 on columns that it doesn't use.
    """
    n, every = x.shape[1], list(range(x.shape[1]))
    weights, so_far = [], np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        y, use = labels[:, k], columns[k] if columns else {}
        own = use.get(-1, every)
        link = _link(np.hstack([x[:, own], so_far]), y, weight)
        whole = np.zeros(n + k + 1)
        whole[own], whole[n:] = link[: len(own)], link[len(own) :]
        weights.append(whole)
        unseen = np.zeros(len(x))
        for fold in np.unique(folds).tolist():
            out, inputs = folds == fold, np.hstack([x[:, use.get(fold, every)], so_far])
            unseen[out] = apply_logistic(inputs[out], _link(inputs[~out], y[~out], weight[~out]))
        so_far = np.hstack([so_far, unseen[:, None]])
    return tuple(weights), so_far


def _counted(known: DataFrame) -> DataFrame:
    """(feature, t_0 …, c_0 …): marked and other documents of known(marked, text, fold) with each feature, by fold.

    Features with too few marked documents are left out.
    """
    names = [f"{kind}_{k}" for kind in "tc" for k in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in names]
        for batch in batches:
            for marked, text, fold in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                counts[fold + FOLDS * (1 - marked)].update(features(text))
        found = list(set().union(*counts))
        columns = [pa.array([c[f] for f in found], pa.int64()) for c in counts]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *columns], ["feature", *names])

    rows = map_arrow(known.select("marked", "text", "fold"), count, ", ".join(["feature binary", *[f"{n} long" for n in names]]))
    summed = rows.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    return checkpointed(summed.where(_total("t") >= MIN_DOCUMENTS))


def _total(kind: str, without: int = -1) -> Column:
    return sum((F.col(f"{kind}_{k}") for k in range(FOLDS) if k != without), F.lit(0))


def _marks(counted: DataFrame, n1: float, n0: float, without: int) -> list[bytes]:
    """The FEATURES features that say most for a category, in documents outside a fold."""
    a, b = _total("t", without) / F.lit(max(1.0, n1)), _total("c", without) / F.lit(max(1.0, n0))
    both = (n1 * a + n0 * b) / (n1 + n0)

    def gain(n: float, share: Column) -> Column:
        """Log-likelihood gained by knowing whether the feature occurs."""
        tiny = 1e-12
        return n * (share * F.log((share + tiny) / (both + tiny)) + (1 - share) * F.log((1 - share + tiny) / (1 - both + tiny)))

    worth = F.round(gain(n1, a) + gain(n0, b), 6)
    told = counted.where((a > b) & (_total("t", without) >= MIN_DOCUMENTS)).select("feature", worth.alias("worth"))
    return [bytes(r["feature"]) for r in told.where("worth > 0").orderBy(F.desc("worth"), "feature").limit(FEATURES).collect()]


def _marks_of(known: DataFrame) -> dict[int, list[bytes]]:
    """The features of a category from known(marked, text, fold): without each fold, and under -1 from all of them."""
    sizes = {(r["marked"], r["fold"]): r["n"] for r in known.groupBy("marked", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = _counted(known)
    marks = {}
    for without in (-1, *range(FOLDS)):
        n1, n0 = (float(sum(n for (kind, k), n in sizes.items() if kind == which and k != without)) for which in (1, 0))
        marks[without] = _marks(counted, n1, n0, without) if n1 and n0 else []
    return marks


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: Sequence[tuple[str, str]] = CATEGORIES,
) -> Chain:
    """A chain of the categories, each a name and a condition on labels; the last one is the chain's verdict."""
    parts = [F.coalesce(F.expr(condition).cast("int"), F.lit(0)) for _, condition in categories]
    usable = labels.where(F.expr(categories[-1][1]).isNotNull() & F.col(id_col).isNotNull())
    # One label of all categories as bits, the last one highest.
    label = sum((p * (1 << k) for k, p in enumerate(parts)), F.lit(0))
    rows = labelled_rows(docs, usable.select(id_col, label.alias("label")), id_col, text_col)
    sample = sampled_texts(docs, rows, id_col, text_col, SAMPLE_ROWS)
    fold = F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(FOLDS)).cast("int")
    # The bounded sample's texts are read for each link: kept once in the shared folder.
    known = checkpointed(sample.select("text", fold.alias("fold"), F.col("label").cast("int").alias("label"), "weight"))
    marks = [_marks_of(known.withColumn("marked", F.shiftright("label", k).bitwiseAND(1))) for k in range(len(categories))]
    every = {f: i for i, f in enumerate(dict.fromkeys(f for link in marks for some in link.values() for f in some))}
    names = tuple(name for name, _ in categories)
    shipped = docs.sparkSession.sparkContext.broadcast(Chain(names, every, ()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(shipped.value.hits(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hits, pa.list_(pa.int32()))], ["fold", "label", "weight", "hits"])

    found = map_arrow(known.select("text", "fold", "label", "weight"), find, "fold int, label int, weight double, hits array<int>").collect()
    found = sorted((r["label"], r["fold"], r["hits"], r["weight"]) for r in found)
    y = np.array([[r[0] >> k & 1 for k in range(len(names))] for r in found], float).reshape(len(found), len(names))
    x = Chain(names, every, ()).matrix([r[2] for r in found], bool)  # a byte for each feature of any link; a link makes numbers of its own
    columns = [{f: [every[m] for m in some] for f, some in link.items()} for link in marks]
    weight = np.array([r[3] for r in found])
    weights, unseen = fit_chain(x, y, np.array([r[1] for r in found], int), weight, columns)
    right = float(np.average((unseen[:, -1] >= 0.5) == (y[:, -1] == 1), weights=weight)) if found else 0.0
    final = list(dict.fromkeys(m for link in marks for m in link[-1]))
    used = [every[m] for m in final]
    return Chain(names, {m: i for i, m in enumerate(final)}, tuple(np.concatenate([w[used], w[len(every) :]]) for w in weights), right, len(found))


def score_documents(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxic, score, one probability per category) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    names: Sequence[str] = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            p = model.probabilities(model.matrix([model.hits(t) for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])]], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = map_arrow(rows, run, ", ".join(["doc_id long", *[f"{n} double" for n in names]]))
    last = F.col(names[-1])
    return scored.select("doc_id", (last >= 0.5).cast("int").alias("toxic"), last.alias("score"), *names[:-1])
