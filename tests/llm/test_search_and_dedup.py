"""Top-k, SimHash and line dedup against brute force."""

import collections
import fractions
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gridmill.llm import line_dedup, simhash, topk
from gridmill.llm.components import components

from .conftest import odd_documents, words


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_print(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, budget=2):
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= budget:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    return [min((x for x in least[top(i)] if x is not None), default=None) for i in range(len(rows))]


def test_simhash_of_odd_documents(odd, none):
    rows = [(d[0], plain_print(d[1])) for d in odd_documents()]
    want = collections.Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, plain_components(rows), strict=True))
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(odd).collect())
    assert got == want
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 5 not in ids and 4 in ids


def test_one_row_of_each_component_stays(spark):
    rows = [(7, "a b c"), (7, "a b c"), (9, "a b c"), *[(None, "quite another text than that")] * 3]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == [(7, "a b c"), (None, "quite another text than that")]


@pytest.mark.parametrize(("budget", "group"), [(0, 200_000), (2, 200_000), (2, 3), (5, 4)])
def test_trie_join_finds_what_all_pairs_find(spark, monkeypatch, budget, group):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:25].tolist():  # chains and clouds around some of them
        for _ in range(12):
            b ^= 1 << int(rng.integers(64))
            fps.add(b ^ (1 << int(rng.integers(64))))
            fps.add(b)
    fps |= {(1 << k) for k in range(64)} | {0}
    rows = [(k, fp) for k, fp in enumerate(sorted(fps))]
    signed = spark.createDataFrame([(fp - 2**64 if fp >= 2**63 else fp,) for _, fp in rows], "fp long")
    links = simhash.links(signed, budget, rows_at_once=37 if group == 3 else simhash.ROWS_AT_ONCE)
    assert all((int(a) ^ int(b)) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in map(tuple, links.collect()))
    roots = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    ours = collections.defaultdict(set)
    for k, fp in rows:
        s = fp - 2**64 if fp >= 2**63 else fp
        ours[roots.get(s, s)].add(k)
    theirs = collections.defaultdict(set)
    for (k, _), c in zip(rows, plain_components(rows, budget), strict=True):
        theirs[c].add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(1000, 1000 + k) for k in range(1, 50)]
    df = spark.createDataFrame(chain + star + [(5, 5), (3, 2)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    assert {roots[k] for k in range(61)} == {0} and {roots[1000 + k] for k in range(50)} == {1000}
    assert components(df.limit(0), "a", "b").count() == 0


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(0, 0.4, 6).tolist(), "x") for k in range(300)]
    rows += [(300 + k, rows[k][1], "x") for k in range(60)]  # ties
    rows += [(400, None, "x"), (401, [0.1, None], "x"), (402, [float("nan")] * 6, "x"), (450, [float("inf")] * 6, "x"), (407, [70_000.0, 1.0], "x"), (408, [0.0] * 5 + [0.25, -1e300], "x"), (409, [], "x"), (404, [], "x"), (405, [0.5, -0.25], "x"), (None, [0.1] * 6, "x"), (50, [9.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    held = [(i, [math.floor(fractions.Fraction(x) * 256) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in held:
        if q % 50 == 0 and q != 50:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in held if i != q)[:5]
            assert got[q] == [(i, -s) for s, i in scores]
    assert set(got) == {q for q, _ in held if q % 50 == 0}
    assert any(i == 407 for found in got.values() for i, _ in found)
    beyond = df.unionByName(spark.createDataFrame([(403, [1e30] * 6, "x")], df.schema))
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(beyond, F.col("vec_id") % 50 == 0).count()
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VALUES", 37 * 8)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.3, (400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(int)
    for r in topk.top_k(df, F.col("vec_id") % 40 == 0, k=3).collect():
        scores = sorted((-(q[r["query_id"]] @ q[i]), i) for i in range(400) if i != r["query_id"])
        assert (-r["score"], r["vec_id"]) == scores[r["rank"] - 1]


def plain_lines(rows):
    """Line numbers that match an earlier line, by comparing every pair."""
    lines = []
    for i, text in rows:
        t = xxhash.xxh64_intdigest((text or "").encode(), 42) if text is not None else 42
        for k, line in enumerate((text or "").split("\n")):
            if words(line):
                lines.append(((2**63 - 1 if i is None else i, t >> 32, k), frozenset(words(lower(line)))))
    gone = collections.defaultdict(set)
    for place, w in lines:
        for other, v in lines:
            if other < place and 5 * len(w & v) >= 4 * len(w | v):
                gone[place[:2]].add(place[2])
    return gone


def hot_rows():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 60
    base = " ".join(rng.choice(vocabulary, 30))
    rows = []
    for d in range(150):
        lines = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 25)))) for _ in range(3)]
        copy = base.split()
        copy[int(rng.integers(30))] = f"n{d}"
        lines.append(" ".join(copy))  # near copies of one line
        lines.append("a line that everyone has " * (1 + d % 2))
        lines.append(" ".join(f"v{(d // 2) * 7 + k}" for k in range(110)) + (" tail" if d % 2 else ""))  # long near pairs
        rows.append((d, "\n".join(lines)))
    return rows


SMALL = line_dedup.Bounds(rows=40, hot=12, short=5, side=3, tries=1)


@pytest.mark.parametrize(
    ("frequent", "bounds", "left"), [(20_000, None, False), (20, None, False), (20, SMALL, False), (200, SMALL, True), (1, None, True)]
)
def test_line_dedup_equals_all_pairs(spark, monkeypatch, frequent, bounds, left):
    """With ``left``, no candidate is taken for a match at first, so that every line is left to the last step."""
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    if left:
        matched, calls = line_dedup._matched, itertools.count()
        monkeypatch.setattr(line_dedup, "_matched", lambda docs, levels, pairs, *given: matched(docs, levels, pairs if next(calls) else pairs.limit(0), *given))
        for name in ("found_in_lists", "found_in_chunks"):
            found = getattr(line_dedup, name)
            monkeypatch.setattr(line_dedup, name, lambda *given, found=found: found(*given).withColumn("more", F.col("other_id").isNotNull()))
    rows = hot_rows()
    want = plain_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: set(r["removed"]) for r in line_dedup.line_report(df, bounds=bounds).collect()}
    assert len(got) == len(rows)
    for (i, _), numbers in want.items():
        assert got[i] == numbers
    assert sum(map(len, got.values())) == sum(map(len, want.values())) > 300


def test_matching_sets_share_a_key():
    """Any two sets that match are listed under a common key, whatever their words' levels; keys stay few."""
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 250, 1 << line_dedup.BUCKET_BITS).astype(np.uint8)

    def lists(sets, frequent):
        held = line_dedup.Lines.of_sets(pa.array([sorted(s, key=lambda h: (levels[h % 2**64 >> 44], h % 2**64)) for s in sets], pa.list_(pa.int64())), levels)
        key, row, _, first = held.keys(np.arange(len(sets)), frequent)
        assert np.array_equal(np.sort(row[first]), np.arange(len(sets)))
        assert np.all(np.bincount(row, minlength=len(sets)) <= np.maximum(1, [0.4 * len(s) + 3 for s in sets]))
        return [set(key[row == k].tolist()) for k in range(len(sets))]

    for frequent in (-1, 100, 200, 230, 255):
        for n in [*range(4, 30), 64, 100, 333]:
            for _ in range(30):
                a = set(rng.integers(-(2**63), 2**63 - 1, n).tolist())
                cut = int(rng.integers(0, n // 5 + 1))
                b = set(rng.permutation(list(a))[cut:].tolist())
                while len(a & b) / len(a | b) >= 0.8:
                    last, b = b, b | {int(rng.integers(-(2**63), 2**63 - 1))}
                    if rng.random() < 0.2:
                        break
                b = last if len(a & b) / len(a | b) < 0.8 else b
                x, y = lists([a, b], frequent)
                assert a == b or x & y


def test_long_lines_of_frequent_words_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 50)
    rng = np.random.default_rng(12)
    common = [f"c{k}" for k in range(6000)]
    long_ = " ".join(common)
    rows = [(k, " ".join(common[: 6000 - 300 * k])) for k in range(6)] + [(6, long_ + " end")]
    rows += [(100 + k, "rare " + " ".join(f"u{x}" for x in rng.integers(0, 10**9, 6))) for k in range(400)]  # unlike lines of one key
    rows += [(1000 + k, rows[7 + 3 * k][1] + " u0") for k in range(60)]
    want = plain_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], n) for r in line_dedup.line_report(df, bounds=line_dedup.Bounds(rows=100, hot=30, short=4, side=7)).collect() for n in r["removed"]}
    assert got == {(i, n) for (i, _), numbers in want.items() for n in numbers} and len(got) > 60


def test_line_dedup_of_odd_documents(odd, none):
    rows = [(d[0], d[1]) for d in odd_documents()]
    want = plain_lines(rows)
    report = line_dedup.line_report(odd).collect()
    assert len(report) == len(rows)
    assert sum(r["n_removed"] for r in report) == sum(len(want.get((2**63 - 1 if i is None else i, (xxhash.xxh64_intdigest(t.encode(), 42) >> 32) if t is not None else 0), ())) for i, t in rows)
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns
    texts = collections.defaultdict(list)
    for r in out.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[4] == [None] and texts[5] == [""] and texts[2] == [""]
    assert texts[14] == ["\nan own line here\nanother own line there"]
    assert line_dedup.line_report(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize(("frequent", "bounds"), [(20_000, None), (8, SMALL)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, frequent, bounds):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = []
    for k in range(25):
        own = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(3, 250)))]
        texts.append(" ".join(own))
        for edits in (0, 1, 2, 4, 6):
            copy = list(own)
            for _ in range(edits):
                copy[int(rng.integers(len(copy)))] = f"x{int(rng.integers(1000))}"
            texts.append("\n".join(" ".join(copy[i : i + 9]) for i in range(0, len(copy), 9)))
        texts.append(passage + " " + " ".join(own[: 5 + k]))  # most of it is common to all
    texts += [None, "", " \n ", "a b", "A  b", "a b c", "a b c d e"]
    rows = [(k, t) for k, t in enumerate(texts)]
    sets = [shingles(t) for t in texts]
    near = [{j for j in range(k) if 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j])} for k in range(len(rows))]
    assert sum(map(bool, near)) > 60
    got = line_dedup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bounds=bounds).collect()
    assert sorted(r["doc_id"] for r in got) == [k for k in range(len(rows)) if not near[k]]


def test_near_copies_of_odd_documents(odd, none):
    got = line_dedup.dedup_documents(odd)
    assert got.columns == odd.columns
    want = [d for d in odd_documents() if d[0] in (None, 1, 3, 4, 7, 8, 9, 11, 12, 13, 14, 15)]
    assert sorted(map(str, got.collect())) == sorted(map(str, (odd.sparkSession.createDataFrame(want, odd.schema)).collect()))
    assert line_dedup.dedup_documents(none).count() == 0
    again = odd.where("doc_id = 8 OR doc_id IS NULL")
    assert line_dedup.dedup_documents(again.unionByName(again)).count() == 3


def test_pipeline_drops_near_copies_of_long_texts(spark, sf):
    w = [f"w{k}" for k in range(200)]
    edited = [f"x{k}" if k in (20, 90, 160) else x for k, x in enumerate(w)]  # 181 of 211 shingles are shared
    assert 0.8 <= len(shingles(" ".join(w)) & shingles(" ".join(edited))) / len(shingles(" ".join(w)) | shingles(" ".join(edited))) < 0.9
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(edited)), (3, " ".join(reversed(w)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()) == [1, 3]


#: The upper 32 bits of their hashes are equal.
COLLIDING = ("text number 224286 alpha beta", "text number 385346 alpha beta")


@pytest.mark.parametrize("id_", [None, 5, 2**63 - 1])
def test_texts_that_share_half_a_hash_stay_apart(spark, id_):
    schema = "doc_id long, text string"
    both = spark.createDataFrame([(id_, t) for t in COLLIDING], schema)
    assert sorted(r["text"] for r in line_dedup.dedup_documents(both).collect()) == sorted(COLLIDING)
    assert [r["removed"] for r in line_dedup.line_report(both).collect()] == [[], []]
    rows = spark.createDataFrame([(1, COLLIDING[0]), *((id_, t) for t in COLLIDING)], schema)
    assert sorted(r["text"] for r in line_dedup.dedup_documents(rows).collect()) == sorted(COLLIDING)
    assert sorted((r["doc_id"] == 1, r["n_removed"]) for r in line_dedup.line_report(rows).collect()) == [(False, 0), (False, 1), (True, 0)]
    assert sorted(r["text"] for r in line_dedup.dedup_lines(rows).collect()) == sorted(["", *COLLIDING])


def test_the_largest_id_is_no_null(spark):
    rows = spark.createDataFrame([(2**63 - 1, "one and the same text here"), (None, "one and the same text here")], "doc_id long, text string")
    assert [r["doc_id"] for r in line_dedup.dedup_documents(rows).collect()] == [2**63 - 1]
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in line_dedup.line_report(rows).collect()) == [(False, 0), (True, 1)]


def test_more_buckets_than_the_session_asks_for(spark, monkeypatch):
    rows = [(k, f"{' '.join(f'w{(k * 7 + j) % 40}' for j in range(6))}\nw1 w2 w3 w4 w{k % 9}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(map(str, line_dedup.line_report(df).collect()))
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", 1)
    assert sorted(map(str, line_dedup.line_report(df).collect())) == whole


def test_one_row_stays_of_a_row_that_is_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PARTS", 3)
    rows = [(7, "a row that occurs again and again", k % 2) for k in range(60)] + [(None, "and one that has no id", k) for k in range(40)] + [(k, f"own text {k} x{k} y{k} z{k} w{k}", 0) for k in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(6)
    got = line_dedup.dedup_documents(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted({(i or 0, t) for i, t, _ in rows})
    assert line_dedup.dedup_documents(df).columns == df.columns
