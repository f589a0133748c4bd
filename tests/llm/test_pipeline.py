"""Every stage of the pipeline, and the scores of the models, against plain programs on the stage's own input."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from gridmill.llm import language_id, quality_classifier, toxicity
from gridmill.llm.queries import tokenizer_path

from .conftest import words
from .test_search_and_dedup import lower, plain_components, plain_lines, shingles


@pytest.fixture(scope="module")
def tables(spark):
    at = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def plain_quality(text, model):
    x = 0.0
    if text and model.good and model.bad:
        sizes = []
        for dictionary in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
            data = text.encode()
            sizes.append(sum(len(c.compress(data[k : k + 512])) for k in range(0, len(data), 512)))
        x = (sizes[1] - sizes[0]) / (sizes[1] + sizes[0])
    z = model.weights[0] * (x - model.scale[0]) / model.scale[1] + model.weights[1]
    return 1 / (1 + math.exp(-max(-35, min(35, z))))


def test_quality_scores_equal_a_plain_program(tables):
    model = quality_classifier.fit(*tables)
    texts = {r["doc_id"]: r["text"] for r in tables[0].collect()}
    for r in quality_classifier.score_documents(tables[0], model).collect():
        assert abs(r["score"] - plain_quality(texts[r["doc_id"]], model)) < 0.02  # a prepared dictionary may cost a byte more or less
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def ascii_letters(text):
    return "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower())


def plain_language(text, model):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = re.sub(b" +", b" ", b" " + ascii_letters(text).encode() + b" ")
    counts = collections.Counter()
    for n in (2, 3, 4):
        for k in range(len(data) - n + 1):
            code = int.from_bytes(bytes([n]) + data[k : k + n], "big")
            counts[(code * 0x9E3779B97F4A7C15 % 2**64) >> 52] += 1
    v = np.zeros(4096)
    for bucket, count in counts.items():
        v[bucket] = math.log1p(count) * model.idf[bucket]
    cosines = model.centroids @ (v / np.linalg.norm(v))
    best = {lang: max(c for c, o in zip(cosines, model.owner, strict=True) if o == k) for k, lang in enumerate(model.languages)}
    top = max(best, key=best.get)
    return top, 1 / sum(math.exp(30.0 * (x - best[top])) for x in best.values())


def test_languages_equal_a_plain_program(tables):
    model = language_id.fit(tables[0])
    texts = {r["doc_id"]: r["text"] for r in tables[0].collect()}
    for r in language_id.predict(tables[0], model).collect():
        lang, score = plain_language(texts[r["doc_id"]], model)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-5


def plain_toxicity(text, chain):
    found = set(ascii_letters(text).split())
    found |= {w.encode()[:n] + b"-" for w in found for n in (4, 5, 6) if len(w.encode()) > n}
    found = {w.encode() if isinstance(w, str) else w for w in found}
    p = []
    for weights in chain.weights:
        z = weights[-1] + sum(weights[k] for f, k in chain.index.items() if f in found)
        z += sum(w * x for w, x in zip(weights[len(chain.index) :], p, strict=False))
        p.append(1 / (1 + math.exp(-max(-35, min(35, z)))))
    return p


def test_toxicity_scores_equal_a_plain_program(tables):
    chain = toxicity.fit(*tables)
    texts = {r["doc_id"]: r["text"] for r in tables[0].collect()}
    for r in toxicity.score_documents(tables[0], chain).collect():
        p = plain_toxicity(texts[r["doc_id"]], chain)
        assert abs(r["p_low_quality"] - p[0]) < 1e-9 and abs(r["score"] - p[1]) < 1e-9 and r["toxic"] == (p[1] >= 0.5)


def test_a_rare_language_is_learned(spark):
    """A few texts among many of another language keep their centroid, and repeats of one row count once."""
    rows = [(k, f"the river and the hills of number {k % 97} were quiet and wide", "en") for k in range(3000)]
    rows += [(5000 + k, f"zwölf boxkämpfer jagen viktor quer über den großen deich {k}", "de") for k in range(9)]
    rows += [(11, "el perro come la manzana en la casa grande", "es")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = language_id.fit(docs)
    assert learned.languages == ("de", "en", "es")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, learned).collect()}
    assert got[5003] == "de" and got[1] == "en"


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def text_place(x):
    import xxhash

    part = xxhash.xxh64_intdigest(x["text"].encode(), 42) >> 32 if x["text"] is not None else 42 >> 32
    return (2**63 - 1 if x["doc_id"] is None else x["doc_id"], part)


def plain_print5(text):
    import xxhash

    w = words(lower(text))
    parts = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_mix(rows):
    """How often each row is taken, by sorting."""
    by = collections.defaultdict(list)
    for k, x in enumerate(rows):
        name = f"{'' if x['doc_id'] is None else x['doc_id']}\n{x['text'] or ''}"
        by[x["source"]].append((hashlib.md5(name.encode()).hexdigest()[:12], k, len(words(x["text"]))))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    size, weight = {s: sum(n for *_, n in by[s]) for s in by}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    held, total = set(), sum(size.values())
    while True:
        rest, shared = total - sum(3 * size[s] for s in held), sum(weight[s] for s in order if s not in held) or 1
        over = {s for s in order if s not in held and rest * weight[s] / shared > 3 * size[s]}
        if not over:
            break
        held |= over
    times = {}
    for s in order:
        target = 3.0 * size[s] if s in held else rest * weight[s] / shared
        passes = min(3, int(target // size[s])) if size[s] else 0
        left, at, open_ = target - passes * size[s], 0, True
        for _, k, n in sorted(by[s]):
            fits = open_ and left < size[s] and at + n / 2 <= left
            open_ = fits and at + n <= left
            times[k] = passes + fits
            at += n
    return times


def test_stages_equal_plain_programs(spark, tables, tmp_path):
    sf, docs = "/root/testdata/sf0.001", tables[0]
    stages = dict(corpus_pipeline.STAGES)
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = as_rows(docs)
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outputs[name] = (before, as_rows(docs))
    same = lambda a, b: collections.Counter(repr(sorted(x.items())) for x in a) == collections.Counter(repr(sorted(x.items())) for x in b)

    before, after = outputs["quality"]
    model = quality_classifier.fit(*tables)
    clear = [x for x in before if abs(plain_quality(x["text"], model) - 0.5) > 0.02]
    kept = {x["doc_id"] for x in after}
    assert all((x["doc_id"] in kept) == (plain_quality(x["text"], model) >= 0.5) for x in clear) and len(clear) > 0.98 * len(before)

    before, after = outputs["lines"]
    gone = plain_lines([(x["doc_id"], x["text"]) for x in before])
    want = []
    for x in before:
        numbers = gone.get(text_place(x), ())
        text = x["text"] and "\n".join(line for k, line in enumerate(x["text"].split("\n")) if k not in numbers)
        want.append(x | {"text": text, "n_chars": None if text is None else len(text)})
    assert same(after, want) and sum(map(len, gone.values())) > 20

    before, after = outputs["near_copies"]
    places, sets = [text_place(x) for x in before], [shingles(x["text"]) for x in before]
    leaders = plain_components([(x["doc_id"], plain_print5(x["text"])) for x in before], budget=corpus_pipeline.NEAR_BITS)
    near = [any(places[j] < places[k] and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in range(len(before))) for k in range(len(before))]
    assert same(after, [x for x, n, leader in zip(before, near, leaders, strict=True) if not n and x["doc_id"] == leader]) and len(after) < len(before)

    before, after = outputs["mixing"]
    times = plain_mix(before)
    assert same(after, [x for k, x in enumerate(before) for _ in range(times[k])])

    before, after = outputs["tokens"]
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    encoded = {x["text"]: library.encode(x["text"] or "", add_special_tokens=False).ids for x in before}
    want = [{"doc_id": x["doc_id"], "n_tokens": len(ids := encoded[x["text"]]), "ids": ids, "decoded": library.decode(ids, skip_special_tokens=False)} for x in before]
    assert same(after, want)
    assert same(as_rows(corpus_pipeline.run(spark, sf)), after) and list(stages) == ["quality", "lines", "near_copies", "mixing", "tokens"]


def test_stages_take_odd_documents(spark, odd, tables, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names pass through every stage."""
    docs, sf = odd, "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == odd.columns
        if name != "quality":  # which would reject most of them
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0 and docs.where(F.col("doc_id") == 7).count() > 0
