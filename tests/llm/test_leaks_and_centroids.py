"""Decontamination and centroid clustering against brute-force versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridmill.llm import decontaminate
from gridmill.llm.centroids import Clustering, cluster_vectors, nearest
from gridmill.llm.decontaminate import Winnowing, Words, contamination_report, drop_contaminated, matched_spans


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = tokens(text)
        for p in range(max(0, len(w) - window) + 1 if w else 0):
            wanted.setdefault(tuple(w[p : p + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = tokens(text), set(), set()
        for m in {len(g) for g in wanted}:
            for p in range(len(w) - m + 1):
                if (of := wanted.get(tuple(w[p : p + m]))) is not None:
                    hit |= set(range(p, p + m))
                    found |= of
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def leaky(seed):
    """Documents and items over few words, so that windows, ties and repeats are frequent."""
    r = random.Random(seed)
    vocabulary = ["a", "b", "Été", "x1", "日本"] if seed % 2 else [f"w{k}" for k in range(60)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, prose(r.choice([12, 25, 60]))) for k in range(8)] + [(8, prose(10)), (9, prose(9)), (10, "w1, W2"), (10, "b a-b"), (None, prose(30)), (11, ""), (12, None), (13, "..!")]
    docs = [(k, prose(r.randrange(0, 80))) for k in range(15)] + [(100, None), (101, ""), (102, " \t"), (None, prose(30)), (103, "x" * 3000)]
    for k, (_, text) in enumerate(items[:12]):
        docs.append((200 + k, f"{prose(7)}; {(text or '').upper() if seed % 3 else text}.\n{prose(5)}"))
        docs.append((300 + k, " ".join((text or "").split()[:9])))  # one word short of a window
        docs.append((400 + k, " ".join((text or "").split()[3:14])))
    docs.append((500, prose(3000) + " " + (items[2][1] or "")))
    return docs + docs[20:30], items


@pytest.mark.parametrize("seed", range(4))
def test_report_equals_brute_force(spark, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(decontaminate, "FILTER_BITS", 6)  # nearly every gram passes by chance
    docs, items = leaky(seed)
    found = contamination_report(
        spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, source string, n_words long").repartition(3),
        spark.createDataFrame([(i, t, "k", b"") for i, t in items], "item_id long, text string, key string, gram binary"),
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)


def test_spans_and_clean_documents(spark):
    shared = [f"s{k}" for k in range(25)]
    docs = spark.createDataFrame([(1, "p q " + " ".join(shared) + " r", 1), (2, " ".join(shared[:9]), 2), (3, None, 3), (3, None, 3)], "doc_id long, text string, key int")
    items = spark.createDataFrame([(7, "z " + " ".join(shared) + " y")], "item_id long, text string")
    spans = [tuple(r) for r in matched_spans(docs, items).collect()]
    assert {(i, item) for i, item, _, _ in spans} == {(1, "7")}
    assert set().union(*(range(a, b + 1) for _, _, a, b in spans)) == set(range(2, 27))
    assert sorted(tuple(r) for r in drop_contaminated(docs, items).select("doc_id", "key").collect()) == [(2, 2), (3, 3), (3, 3)]
    assert drop_contaminated(docs, items).columns == docs.columns


def test_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x " * 12)], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination_report(docs, items.limit(0)).collect()] == [(1, 3, 0, 0)]
    assert contamination_report(docs.limit(0), items).collect() == []


def test_every_shared_span_has_a_kept_gram():
    r = random.Random(5)
    how = Winnowing(window=8, gram=3)
    for _ in range(300):
        shared = [r.choice("abc") for _ in range(8)]
        sides = []
        for _ in range(2):
            before = [r.choice("abcd") for _ in range(r.randrange(9))]
            text = " ".join([*before, *shared, *(r.choice("abcd") for _ in range(r.randrange(9)))]).encode()
            place, _ = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).kept(how)
            sides.append({int(p) - len(before) for p in place if 0 <= p - len(before) <= 5})
        assert sides[0] & sides[1]


def plain_clusters(rows, how):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == how.dimensions and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [int(np.floor(float(c) * how.scale)) for c in v]))
    key = lambda r: (hashlib.sha256(f"{how.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[: how.clusters]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v: min((gap(v, c), k) for k, c in enumerate(centroids))
    for _ in range(how.rounds):
        members = {}
        for _, v in kept:
            members.setdefault(best(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else c for k, c in enumerate(centroids)]
    found = [(i, *best(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, sum(e for _, j, e in found if j == k), total, digest[k]) for i, k, d in found), key=str)


def vectors(n, dims, seed=0):
    r = np.random.default_rng(seed)
    v = np.round(r.normal(0, 0.2, (n, dims)) + r.integers(0, 3, (n, 1)), 1).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    odd = [None, [], [1.0] * (dims - 1), [None] + [0.0] * (dims - 1), [float("nan")] * dims, [float("-inf")] + [0.0] * (dims - 1), [0.0] * (dims + 1)]
    return rows + [(1000 + k, x) for k, x in enumerate(odd)] + [(None, v[0].tolist()), (3, v[5].tolist()), (4, v[4].tolist()), (2000, [1e6] + [0.0] * (dims - 1)), (2001, [-0.0] * dims)]


@pytest.mark.parametrize("how", [Clustering(), Clustering(clusters=5, rounds=2, dimensions=12, scale=10, seed=3), Clustering(clusters=400, dimensions=3), Clustering(rounds=0, dimensions=9)])
def test_clusters_equal_plain_version(spark, how):
    rows = vectors(120, how.dimensions)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    found = sorted((tuple(r) for r in cluster_vectors(df, how=how).collect()), key=str)
    assert found == plain_clusters(rows, how)


def test_no_vectors_and_too_large_ones(spark):
    schema = "vec_id long, embedding array<float>"
    assert cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    assert cluster_vectors(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], schema)).collect()


def test_search_abandons_only_what_is_strictly_farther():
    r = np.random.default_rng(2)
    x, centroids = r.integers(0, 3, (500, 20)), r.integers(0, 3, (40, 20))
    whole = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    cluster, distance = nearest(x, centroids, r.permutation(20))
    assert (cluster == whole.argmin(axis=1)).all()  # many ties: the smaller number
    assert (distance == whole.min(axis=1)).all()


def test_sliced_batches():
    from gridmill.llm.centroids import integers

    how = Clustering(dimensions=2, scale=2)
    array = pa.array([[1.0, 2.0], None, [3.0, -0.1], [4.0]], pa.list_(pa.float32())).slice(1)
    rows, x = integers(array, how)
    assert rows.tolist() == [1]
    assert x.tolist() == [[6, -1]]
