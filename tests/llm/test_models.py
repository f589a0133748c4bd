"""Classifiers on held-out rows, the tokenizer against its library, and the pipeline."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmill.llm import language_id, quality_classifier, toxicity
from gridmill.llm.bpe import Encoder, Vocabulary, encode_documents, token_digests
from gridmill.llm.queries import QUERIES, tokenizer_path

from .conftest import odd_documents

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def middle(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")


def test_quality_on_held_out_rows(spark, middle):
    out = QUERIES["op6_quality"](spark, MIDDLE)
    rows = out.join(middle[1], "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
    unseen = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in unseen]) > 0.94
    good = [r for r in unseen if r["quality"] == 1]
    assert np.mean([r["predicted"] for r in good]) > 0.97
    assert out.count() == 1000


def test_quality_of_odd_documents(odd, none, middle):
    model = quality_classifier.fit(*middle)
    again = quality_classifier.fit(middle[0].repartition(7), middle[1])
    assert model == again
    rows = quality_classifier.score_documents(odd, model).collect()
    assert len(rows) == len(odd_documents()) and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality_classifier.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in rows)
    blank = quality_classifier.fit(none, none.select("doc_id", F.lit(1).alias("quality")))
    assert {r["score"] for r in quality_classifier.score_documents(odd, blank).collect()} == {0.5}
    assert quality_classifier.score_documents(none, model).count() == 0 and quality_classifier.keep_good(none, model).count() == 0


def test_language_on_held_out_rows(spark, middle):
    rows = QUERIES["op7_language"](spark, MIDDLE).join(middle[0].select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == 1000
    unseen = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in unseen]) > 0.97


def test_language_of_odd_documents(spark, odd, none, middle):
    model = language_id.fit(middle[0])
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6))
    assert got[1]["lang_pred"] in model.languages and 0 < got[1]["score"] <= 1
    digits = spark.createDataFrame([(1, "123 456 !?"), (2, "zzzz qqqq xxxx jjjj")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in language_id.predict(digits, model).collect()}
    assert out[1]["lang_pred"] == "und" and out[2]["lang_pred"] in model.languages and out[2]["rejected"]
    assert language_id.fit(none) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_toxicity(spark, middle):
    rows = QUERIES["op1_toxicity"](spark, MIDDLE).collect()
    assert len(rows) == 1000
    label = {r["doc_id"]: r["toxic"] for r in middle[1].collect()}
    known = [r for r in rows if r["doc_id"] in label]
    clean = [r for r in known if not label[r["doc_id"]]]
    assert np.mean([r["toxic"] for r in clean]) < 0.01
    assert np.mean([r["toxic"] for r in known if label[r["doc_id"]]]) > 0.85


def test_toxicity_learns_for_unseen_rows(middle):
    docs, labels = middle
    seen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    chain = toxicity.fit(docs, seen)
    rows = toxicity.score_documents(docs, chain).join(labels.withColumnRenamed("toxic", "label").join(seen, "doc_id", "left_anti"), "doc_id").collect()
    assert np.mean([r["toxic"] == r["label"] for r in rows]) > 0.95
    assert chain.unseen_right > 0.92 and chain.unseen_rows == seen.count()


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 4)).astype(float)
    first = x[:, 0]
    y = np.stack([first, first * x[:, 1], np.zeros(600)], 1)
    folds = np.arange(600) % 5
    weights, unseen = toxicity.fit_chain(x, y, folds, np.ones(600))
    assert ((unseen >= 0.5) == (y == 1)).all()
    assert [len(w) for w in weights] == [5, 6, 7]
    p = toxicity.Chain(("a", "b", "c"), {}, weights).probabilities(x)
    assert ((p >= 0.5) == (y == 1)).all()


def test_toxicity_of_odd_documents(odd, none, middle):
    chain = toxicity.fit(*middle)
    assert toxicity.score_documents(odd, chain).where("toxic = 1").count() == 0
    assert toxicity.score_documents(none, chain).count() == 0
    blank = toxicity.fit(none, none.select("doc_id", F.lit(1).alias("toxic"), F.lit(1).alias("quality")))
    assert toxicity.score_documents(odd, blank).where("toxic = 0").count() == len(odd_documents())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library_on_random_texts(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = Encoder(Vocabulary(f.read()))
    rng = random.Random(3)
    pool = "   　\x1d᠎aAbBeÉ̀ \t\n'sStTlLdDmMrR1²Ⅷ.,!<|>éßΣσςİıǅ日\U0001f600\x00\x1c\x85\xa0​ _"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", "x" * 3000, "ab" * 4000, "<|endoftext|><|startoftext|>a<|ENDOFTEXT|>", "ΑΣ ΣΑΣ. I'LL it'S"]
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, np.int32).tolist() == want, repr(text)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_long_words_are_merged_at_once(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        vocabulary = Vocabulary(f.read())
    rng = random.Random(7)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (257, 300, 1000, 5000)]
    texts += ["a" * n for n in (256, 257, 511, 4097)] + ["the" * 700 + "a", "ab" * 300 + "aab" * 200, "😀" * 200]
    for at_once in (vocabulary.at_once, np.zeros_like(vocabulary.at_once)):
        vocabulary.at_once = at_once
        for text, (ids, _) in zip(texts, Encoder(vocabulary).encode(texts), strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_odd_documents(odd, none, library):
    encoded = encode_documents(odd, tokenizer_path())
    got = collections.Counter(tuple(r) for r in token_digests(encoded).collect())
    want = collections.Counter()
    for d in odd_documents():
        ids = library.encode(d[1] or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want[(d[0], len(ids), *digest)] += 1
    assert got == want
    assert encode_documents(none, tokenizer_path()).count() == 0


def test_pipeline(spark, middle, tmp_path):
    docs = middle[0]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MIDDLE).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append((name, before.count(), docs.count()))
        if name != "tokens":
            assert docs.columns == middle[0].columns
    counts = {name: (a, b) for name, a, b in seen}
    assert counts["quality"][1] < counts["quality"][0] and counts["lines"][0] == counts["lines"][1]
    assert counts["near_copies"][1] < counts["near_copies"][0] and counts["tokens"][0] == counts["tokens"][1]
    assert corpus_pipeline.run(spark, MIDDLE).count() == counts["tokens"][1]


def test_pipeline_stages_take_empty_tables(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_dictionaries_are_trained_on_texts_of_bounded_size(spark, monkeypatch):
    from gridmill.llm import quality_classifier

    assert quality_classifier._within(10, [(0, 5, 7), (0, 2, 4), (0, 9, 6), (1, 1, 11), (1, 3, 10)]) == [2, 9, 3]
    docs = spark.createDataFrame([(k, f"{'good plain words' if k % 2 else 'zz## $$ qq'} {k} " * (3000 if k == 4 else 20)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 10_000)
    model = quality_classifier.fit(docs, labels)
    assert 0 < len(model.good) <= 65536 and 0 < len(model.bad) <= 65536
    scored = quality_classifier.score_documents(docs, model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored)
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 1)
    assert {r["score"] for r in quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels)).collect()} == {0.5}
