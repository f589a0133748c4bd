"""From raw documents to token ids: five stages over the operators of gridmill.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Its output is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents, extra ones untouched whatever their names.
Null and empty texts, repeated rows, empty tables and very long texts pass
through: each stage gives what its operator's module defines for them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import quality_classifier, simhash
from gridmill.llm._base import shared_folder, table
from gridmill.llm.bpe import encode_documents
from gridmill.llm.line_dedup import dedup_documents, dedup_lines
from gridmill.llm.mixing import mix_documents
from gridmill.llm.queries import tokenizer_path

#: Differing bits of two fingerprints of five-word shingles that count as near copies.
NEAR_BITS = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier rejects."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that match an earlier line; every document stays, and its n_chars, where it has one, is counted anew."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first document stays.

    A document goes if SimHash links it to an earlier one: fingerprints of its
    five-word shingles within NEAR_BITS, or a chain of such. Most pairs with a
    Jaccard similarity just above 0.8 lie beyond any budget that a fingerprint
    of 64 bits can afford, so a document also goes if the sets of its five-word
    shingles have 0.8 or more with those of an earlier one, by the exact join.
    """
    return dedup_documents(docs, words=5, also=simhash.copies(docs, words=5, budget=NEAR_BITS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the source weights ask for."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the text that they decode to."""
    encoded = encode_documents(docs, tokenizer_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents of sf_dir.

    A stage's output is deleted once the next one is written; that of the last
    stage but one stays, as the result reads it.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES[:-1]):
        now = f"{folder}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(now), now
    return STAGES[-1][1](spark, docs, sf_dir)
