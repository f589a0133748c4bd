import re

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("row", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "r", -1, "h", "x", None)


PROSE = "the quick brown fox jumps over the lazy dog and runs far away from the old house by the river"


def odd_documents():
    long_ = " ".join(f"w{k % 977} of the" for k in range(20_000))
    return [
        doc(1, PROSE),
        doc(2, PROSE),  # an exact copy
        doc(3, PROSE.replace("lazy", "sleepy")),
        doc(4, None, None, None),
        doc(5, ""),
        doc(6, " \t\n\x0b "),
        doc(None, "a text without an id that goes on for a while", "en", "b"),
        doc(None, "another text without an id and quite unlike", "en", None),
        doc(7, long_),
        doc(8, "word"),
        doc(9, "two words", "fr", ""),
        doc(10, PROSE),
        doc(10, PROSE),  # a repeated row
        doc(11, "spam spam spam spam spam spam spam spam spam spam " * 4),
        doc(12, "Ünïcödé ΑΣ 日本語 \U0001f600 naïvé \x1c\x85 end", "de", "b"),
        doc(13, "x" * 5000),
        doc(14, f"{PROSE}\n\nan own line here\n{PROSE}\nanother own line there"),
        doc(15, "<|endoftext|>the end<|startoftext|>"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
