"""Quality rules, mixing and sharding against plain Python and SQL."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import mixing, sharding
from gridmill.llm.oracles import ORACLES
from gridmill.llm.quality_rules import quality_rules
from gridmill.llm.queries import QUERIES

from .conftest import odd_documents, words


def counts(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_rules_on_odd_texts(odd, none):
    got = collections.Counter(
        (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules(odd).collect()
    )
    want = collections.Counter()
    for d in odd_documents():
        c = counts(d[1])
        want[(d[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert got == want
    assert quality_rules(odd).where("base_failed AND kept").count() == 0
    assert quality_rules(none).count() == 0


def test_rules_stay_native(odd):
    plan = quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "sale_lines", "sales", "items", "vendors", "clients"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(repr(tuple(r[at[c]] for c in columns)) for r in cursor.fetchall())


def brute_mix(rows, weights=(5, 2, 1), top=3):
    """Sorting and summing source by source."""
    import hashlib

    by = collections.defaultdict(list)
    for k, (doc_id, source, text) in enumerate(rows):
        named = ("" if doc_id is None else str(doc_id)) + "\n" + (text or "")
        by[source].append(((int(hashlib.md5(named.encode()).hexdigest()[:12], 16), k), len(words(text))))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total, size = sum(x[1] for v in by.values() for x in v), {s: sum(x[1] for x in by[s]) for s in by}
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    held = set()
    while True:
        rest, shared = total - sum(top * size[s] for s in held), sum(w[s] for s in order if s not in held) or 1
        over = {s for s in order if s not in held and rest * w[s] / shared > top * size[s]}
        if not over:
            break
        held |= over
    target = {s: float(top * size[s]) if s in held else rest * w[s] / shared for s in order}
    taken = collections.Counter()
    for s in order:
        passes = min(top, int(target[s] // size[s])) if size[s] else 0
        left, at = target[s] - passes * size[s], 0
        groups = collections.OrderedDict()
        for h, n in sorted(by[s]):
            groups[h] = groups.get(h, 0) + n
        take = set()
        for h, n in groups.items():
            if at + n / 2 <= left and left < size[s]:
                take.add(h)
            at += n
        taken[s] = sum(n * (passes + (h in take)) for h, n in by[s])
    return target, taken, size


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_mix_of_odd_documents(odd, none, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    got = mixing.mix_report(odd).collect()
    target, taken, size = brute_mix([(d[0], d[3], d[1]) for d in odd_documents()])
    mine = collections.Counter()
    for r in got:
        mine[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
    assert mine == taken and len(got) == len(odd_documents())
    assert mixing.mix_report(none).count() == 0
    assert mixing.mix_documents(none).columns == none.columns


def test_mix_emits_what_it_reports(documents):
    want = mixing.mix_report(documents).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix_documents(documents)
    assert mixed.columns == documents.columns
    assert mixed.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == want


@pytest.mark.parametrize("same", [False, True])
def test_mix_of_many_rows_of_one_id(spark, same):
    """Rows that share an id, or id and text, don't move together: targets are met to a document or two."""
    rows = [(None if k % 2 else 7, f"{'x' if same else k} " * 10, "ab"[k % 3 == 0]) for k in range(1000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(got) == 1000
    for source in "ab":
        taken = sum(r["taken"] for r in got if r["source"] == source)
        target = next(r["target"] for r in got if r["source"] == source)
        assert abs(taken - target) <= 30


def test_excess_is_reshared_until_none_is_above(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 1), ("b", 2), ("c", 400), ("d", 3), ("e", 5), ("f", 900)])]
    sized = spark.createDataFrame(rows, "doc_id long, source string, source_size long").select("source", "source_size")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    want = brute_mix([(i, s, "w " * n) for i, s, n in rows])[0]
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want) and abs(sum(got.values()) - 1311) < 1e-6


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_loop():
    keys = np.random.default_rng(3).integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards_of_odd_documents(odd, none):
    rows = sharding.shard_manifest(odd).collect()
    want = collections.Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in odd_documents())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.shard_manifest(none).count() == 0


def test_many_equal_rows_get_slots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 7)
    df = spark.createDataFrame([(5, "same")] * 50 + [(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    rows = sharding.shard_manifest(df).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) == 150


def test_write_shards(spark, tmp_path, documents):
    sharding.write_shards(documents, "doc_id", 4, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 4
