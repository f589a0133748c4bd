"""Operators on plain DataFrames, where workers have neither the package nor the driver's path."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from gridmill.llm import bpe, centroids, decontaminate, language_id, line_dedup, mixing, quality_classifier, quality_rules, sharding, simhash, target_encoding, topk, toxicity
from gridmill.llm.queries import tokenizer_path

docs = spark.createDataFrame([(k, f"some words and others {{k % 3}}\\na line of its own {{k}}", "en", "a") for k in range(30)], "doc_id long, text string, lang string, source string")
labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
vectors = spark.createDataFrame([(k, [k / 7, -k / 3]) for k in range(60)], "vec_id long, embedding array<double>")
counts = [
    toxicity.score_documents(docs, toxicity.fit(docs, labels)).count(),
    simhash.simhash_components(docs).count(),
    topk.top_k(vectors, F.col("vec_id") % 50 == 0).count(),
    quality_rules.quality_rules(docs).count(),
    mixing.mix_report(docs).count(),
    quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels)).count(),
    language_id.predict(docs, language_id.fit(docs)).count(),
    sharding.shard_manifest(docs).count(),
    line_dedup.line_report(docs).count(),
    bpe.encode_documents(docs, tokenizer_path()).count(),
    target_encoding.time_ordered_rates(
        docs.select((F.col("doc_id") % 9).alias("at"), (F.col("doc_id") % 5).cast("int").alias("fold"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), (F.col("doc_id") % 3).alias("k"), "doc_id"),
        ["k"], [docs.select("doc_id", "lang")], ["doc_id"]
    ).count(),
    decontaminate.contamination_report(docs, docs.limit(3), item_col="doc_id").count(),
    centroids.cluster_vectors(vectors, how=centroids.Clustering(dimensions=2)).count(),
]
print("COUNTS", counts, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
"""


def test_operators_run_from_a_foreign_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not p.startswith(root)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(kept)}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "COUNTS [30, 30, 10, 30, 30, 30, 30, 30, 30, 30, 30, 30, 60] 10000" in done.stdout, done.stderr[-3000:]
