"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_classifier, toxicity
from ._base import table
from .bpe import encode_documents, token_digests
from .centroids import cluster_vectors
from .decontaminate import contamination_report
from .line_dedup import line_report
from .mixing import mix_report
from .quality_rules import quality_rules
from .sharding import shard_manifest
from .simhash import simhash_components
from .target_encoding import sale_line_rates
from .topk import top_k


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(table(spark, sf_dir, "documents"), n_shards=8)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_report(table(spark, sf_dir, "documents"))
    return report.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), " "))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_target_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_line_rates(*(table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items", "vendors", "clients")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_top_k": op3_top_k,
    "op4_quality_rules": op4_quality_rules,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_shards": op8_shards,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_target_rates": op11_target_rates,
    "op12_decontamination": op12_decontamination,
    "op13_centroids": op13_centroids,
}
