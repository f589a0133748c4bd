"""Paths that hang on sizes give the same rows on either side."""

from pyspark.sql import functions as F

from gridmill.llm import bpe, mixing, sharding, toxicity
from gridmill.llm.queries import tokenizer_path
from gridmill.llm.sharding import shard_manifest
from gridmill.llm.topk import top_k


def rows(df):
    return sorted(map(str, df.collect()))


def test_buckets_of_a_shard(spark, documents, odd, monkeypatch):
    for docs in (documents, odd):
        whole = {(r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in shard_manifest(docs, 3).collect()}
        monkeypatch.setattr(sharding, "BUCKET_ROWS", 2)
        monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 1)
        small = shard_manifest(docs, 3).collect()
        monkeypatch.undo()
        assert {(r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in small} == whole and len(small) == docs.count()
        for shard in range(3):
            slots = sorted(r["slot"] for r in small if r["shard"] == shard)
            assert slots == list(range(len(slots)))


def test_blocks_of_queries_and_rows(spark, sf, monkeypatch):
    from gridmill.llm import topk

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = rows(top_k(vectors, F.col("vec_id") % 10 == 0))
    for name, value in (("MOST_QUERIES", 3), ("BLOCK_VALUES", 64 * 40), ("BLOCK_QUERIES", 2), ("TASKS", 1)):
        monkeypatch.setattr(topk, name, value)
        assert rows(top_k(vectors, F.col("vec_id") % 10 == 0)) == whole


def test_a_cache_that_holds_few_words(documents, odd, monkeypatch):
    with open(tokenizer_path()) as f:
        vocabulary = bpe.Vocabulary(f.read())
    texts = [r["text"] or "" for r in [*documents.limit(40).collect(), *odd.collect()]]
    whole = bpe.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small = bpe.Encoder(vocabulary)
    assert [small.encode([t])[0] for t in texts] == whole and [small.encode([t])[0] for t in texts[::-1]] == whole[::-1]


def test_mixed_rows_keep_the_hash_that_was_counted(spark, monkeypatch):
    """A source order that changes between computations changes nothing once rows are hashed."""
    docs = spark.createDataFrame([(1, "same words in every row", "a")] * 40 + [(k, f"other words {k}", "b") for k in range(30)], "doc_id long, text string, source string")
    mixed = mixing.mix_documents(docs.repartition(5))
    counts = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    report = mixing.mix_report(docs.repartition(5)).groupBy("source").agg((F.sum("taken") / F.first("size")).alias("n")).collect()
    assert abs(counts["a"] - next(r["n"] for r in report if r["source"] == "a")) <= 1


def test_links_have_features_of_their_own(spark):
    texts = [(k, f"filler text {k % 7} " + ("dross " if k % 3 == 0 else "polish ") + ("venom" if k % 2 else "honey")) for k in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1, k % 2) for k in range(240)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    low, toxic = (w[: len(chain.index)] for w in chain.weights)
    assert low[chain.index[b"dross"]] > 1 and toxic[chain.index[b"venom"]] > 1
    assert toxic[chain.index[b"dross"]] == 0 and low[chain.index[b"venom"]] == 0
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, chain).collect()}
    assert all(found[k]["toxic"] == k % 2 and (found[k]["p_low_quality"] > 0.5) == (k % 3 == 0) for k in range(240))
