"""Whole queries on the smallest tables against brute force, and operators on odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import jaccard, licenses, packing, sharding, toxicity, vectors

SF = "/root/testdata/sf0.001"


def smallest(low, pairs):
    """For each item the smallest one that links reach."""
    while True:
        before = dict(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op8_names_the_least_document_of_each_component(spark, documents):
    sets = {}
    for i, text in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = smallest({i: i for i in ids}, pairs)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.op8(spark, SF).collect()}
    assert got == {(i, len(sets[i]), low[i]) for i in ids} and len(pairs) > 10


def test_op10_keeps_one_vector_of_each_component(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["label"] is not None and r["embedding"] is not None}
    x = {k: v / np.linalg.norm(v) for k, v in x.items() if v.any()}
    label, ids = {r["vec_id"]: r["label"] for r in rows}, sorted(x)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if label[a] == label[b] and x[a] @ x[b] >= 0.93]
    low, links = smallest({r["vec_id"]: r["vec_id"] for r in rows}, pairs), Counter(i for p in pairs for i in p)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.op10(spark, SF).collect()}
    assert got == {(i, links[i], c, i == c) for i, c in low.items()}


def test_op2_sizes_checksums_and_groups(spark, documents):
    rows = sharding.op2(spark, SF).collect()
    text = dict(documents)
    counts, where, split = Counter(r["shard"] for r in rows), {}, 0
    assert len(rows) == len(documents) and max(counts.values()) - min(counts.get(k, 0) for k in range(24)) <= 1
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        where.setdefault(data, set()).add(r["shard"])
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    copies = Counter((text[r["doc_id"]] or "").encode() for r in rows)
    small = [d for d, n in copies.items() if 1 < n <= min(counts.values())]
    assert sum(len(where[d]) > 1 for d in small) <= len(small) / 4  # copies stay together where quotas allow


def test_op9_folds_labels_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcde"), 4))
    docs = [(i if i != 7 else None, " ".join([word() for _ in range(12)] + ["vile filth"] * (i % 2))) for i in range(160)] + [(500, None), (501, "")]
    frame = spark.createDataFrame(docs + [docs[3]] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    sample = toxicity.training_rows(frame, labels)
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    assert Counter(r["doc_id"] for r in sample) == Counter(i for i in range(160) if i != 7 and fold(i) != 2)
    rows = toxicity.score_documents(frame, labels).collect()
    assert len(rows) == len(docs) + 30
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"]) == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert len({round(r["score"], 6) for r in rows if r["doc_id"] == 3}) == 1
    none = toxicity.score_documents(frame, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_documents(frame.where("false"), labels).count() == 0


def aligned(words, template):
    """Whether a passage stands in words with its key phrases in place, by trying every place."""
    label, text, keys = template
    body = text.split()
    spots = [next(i for i in range(len(body)) if body[i : i + len(k.split())] == k.split()) for k in keys]
    for o in range(1 - len(body), len(words)):
        at = [words[o + p] if 0 <= o + p < len(words) else None for p in range(len(body))]
        if all(at[s : s + len(k.split())] == k.split() for s, k in zip(spots, keys)) and sum(a == b for a, b in zip(at, body)) >= licenses.LEAST_MATCH * len(body):
            return True
    return False


def test_op1_labels_are_those_of_every_place(spark, documents):
    rng = np.random.default_rng(5)
    made = []
    for _, text, _ in licenses.TEMPLATES:
        w = text.split()
        for share in (0.1, 0.3, 0.6):  # some words changed: some passages still match, some don't
            made.append(" ".join("other" if rng.random() < share else x for x in w))
    texts = [t for _, t in documents] + made + [None, "", "license " * 3000, "MIT License"]
    frame = spark.createDataFrame([(i, t, "mine", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, hits string, ws double")
    found = licenses.scan(frame)
    assert found.columns[:4] == ["doc_id", "text", "hits", "ws"] and found.where("hits = 'mine' and ws = 1.5").count() == len(texts)
    got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in found.collect()}
    indexed = 0
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        want = {t[0] for t in licenses.TEMPLATES if aligned(words, t)}
        assert got[i] <= want  # no label without its passage
        indexed += len(want - got[i])
    assert indexed <= 0.1 * sum(map(len, got.values()))  # the index asks for two fifths of the indexed words in line
    assert licenses.scan(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(frame.withColumn("score", F.lit(1)))


def test_packing_breaks_ties_and_repeats_alike(spark):
    rows = [(1, "a b c")] * 5 + [(None, "a b c"), (2, None), (3, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), max_length=8, buckets=2, budget=16).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == {(1, 4): 5, (None, 4): 1, (2, 1): 1, (3, 1): 1}
