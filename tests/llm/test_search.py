"""Ranked search, hard negatives and decontamination against brute force, and on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tablewarden.llm import decontamination, negatives, ranking

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = ["".join(rng.choice("aeiourst") for _ in range(rng.randint(1, 3))) for _ in range(70)] + ["É", "é", "ß", "漢字"]
    say = lambda n: " ".join(rng.choice(word) for _ in range(n))
    docs = [say(rng.randint(1, 60)) for _ in range(300)]
    items = [say(rng.randint(1, 30)) for _ in range(25)] + ["Zzz-yyy", "", None, "É é É", "..."]
    for k in range(0, 300, 4):
        docs[k] += " . " + rng.choice(items[:25]).upper()
    docs += [docs[8]] * 40 + ["", None, "  ", "É É é", say(40_000), items[3], "X" * 5000]
    return [(i if i % 29 else None, t) for i, t in enumerate(docs)], [(f"q{i}" if i != 5 else None, t) for i, t in enumerate([*items, items[2]])]


def clashing(spark, rows, key):
    """A table with columns that are named like those inside the operators."""
    return spark.createDataFrame([(k, t, "x", 1, None) for k, t in rows], f"{key}, text string, `a.b` string, words int, i1 long")


def brute_ranks(docs, items):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out.update((item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:10]))
    return out


def test_ranking(spark, texts):
    docs, items = texts
    got = ranking.rank_documents(clashing(spark, docs, "doc_id long"), clashing(spark, items, "item_id string")).collect()
    assert Counter(tuple(r) for r in got) == brute_ranks(docs, items)


def test_ranking_in_blocks_and_small_trees(spark, texts, monkeypatch):
    docs, items = texts
    for name, value in (("BLOCK_BYTES", 300), ("TREE", 64), ("LEAF", 4)):
        monkeypatch.setattr(ranking, name, value)
    some = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranking.rank_documents(some, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute_ranks(docs, items)


def test_bounds_prune_trees():
    """Documents in tight groups: an item's own group is scored and others are not."""
    import numpy as np

    rng, groups = np.random.default_rng(1), 32
    lists = [np.arange(g * 50, g * 50 + 25) for g in range(groups) for _ in range(64)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    rows = ranking.Rows(offsets, np.concatenate(lists), rng.integers(90, 110, offsets[-1]))
    tree = ranking.ball_tree(np.arange(len(lists)), np.ones(len(lists), bool), rows, groups * 50)
    tree = {k: np.asarray(v) for k, v in tree.items()}
    seen, search = [], ranking.Search([(lists[0], np.full(len(lists[0]), 5))], groups * 50, 10)
    score = search.score
    search.score = lambda *a: (seen.append(a[4] - a[3]), score(*a))
    search.visit(tree)
    want = sorted(((-int(5 * rows.vals[offsets[i] : offsets[i + 1]][np.isin(x, lists[0])].sum()), i) for i, x in enumerate(lists)))[:10]
    assert [(-s, i) for s, i in zip(search.found[0][0], search.found[0][2])] == want
    assert sum(seen) < len(lists) / 2


def test_ranking_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "x"), ("b", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "y"), (2, None)], "doc_id long, text string")
    assert ranking.rank_documents(none, items).count() == 0
    assert ranking.rank_documents(docs, items).count() == 0
    assert ranking.rank_documents(docs, items.where("false")).count() == 0


def brute_negatives(rows):
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * v) for v in x]) for i, y, x in rows if i is not None and y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = Counter()
    for i, y, x in rows:
        if i % 50:
            continue
        met = [(-sum(a * b for a, b in zip(x, z)), j, k) for j, k, z in rows if j != i and len(z) == len(x)]
        for s, j in sorted((s, j) for s, j, k in met if k == y)[:5]:
            found = sorted((t, h) for t, h, k in met if k != y and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out.update((i, j, r + 1, h, -s, -t) for r, (t, h) in enumerate(found))
    return out


@pytest.mark.parametrize("leaf", [128, 4])
def test_negatives(spark, monkeypatch, leaf):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "TREE", 90)
    rng = random.Random(leaf)
    center = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, rng.randint(0, 4), [c + rng.gauss(0, 0.3) for c in rng.choice(center)]) for i in range(420)]
    rows += [(500 + i, 1, rows[50][2]) for i in range(60)] + [(600, 2, rows[50][2]), (600, 2, rows[50][2]), (650, 2, [1.0, 2.0]), (651, 2, [1.0, 2.5]), (652, 3, [1.0, 1.5])]
    rows += [(None, 1, rows[0][2]), (700, None, rows[0][2]), (750, 1, None), (800, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (850, 1, [float("nan")] * 6), (900, 1, [float("inf")] * 6), (950, 9, []), (951, 9, []), (953, 3, []), (1000, 1, [0.0] * 6), (1001, 1, [-1e9] * 6)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, `a.b` string, pick int").repartition(4)
    got = negatives.mine_negatives(df).collect()
    assert Counter(tuple(r) for r in got) == brute_negatives(rows)


def test_negatives_beyond_exact_doubles(spark):
    rows = [(50, 1, [2.0**21 + 1 / 256, 1.0]), (51, 1, [2.0**21 + 3 / 256, 1.0]), (52, 2, [2.0**20 + 1 / 256, 1.0]), (53, 2, [2.0**20 + 2 / 256, 1.0]), (100, 3, [1.0, 0.0])]
    got = negatives.mine_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in got) == brute_negatives(rows)


def test_negatives_in_blocks_of_anchors_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.random() for _ in range(4)]) for i in range(0, 400, 5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    assert Counter(tuple(r) for r in negatives.mine_negatives(df).collect()) == brute_negatives(rows)
    assert negatives.mine_negatives(df.where("vec_id % 50 <> 0")).count() == 0
    assert negatives.mine_negatives(df.where("false")).count() == 0


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_hits(docs, items):
    held = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            held[tuple(w[p : p + n])].add(item)
    lengths, out = {len(k) for k in held}, Counter()
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (win := tuple(w[p : p + n])) in held:
                    hit.update(range(p, p + n))
                    found |= held[win]
        out[(i, len(w), len(hit), tuple(sorted(x for x in found if x is not None)), bool(hit))] += 1
    return out


@pytest.mark.parametrize("passes", [1, 3])
def test_decontamination(spark, texts, monkeypatch, passes):
    if passes > 1:
        monkeypatch.setattr(decontamination, "PASS", 150)
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    docs, items = texts
    docs = docs + [(900 + n, " ".join(["lo"] * n)) for n in (3, 9, 10, 11, 40)] + [(950, "one " + items[1][1]), (951, items[1][1] + "x")]
    items = items + [("same", " ".join(["lo"] * 12)), ("short", "zzz YYY")]
    frame = clashing(spark, docs, "doc_id long")
    found = decontamination.contamination(frame, clashing(spark, items, "item_id string"))
    assert found.columns[: len(frame.columns)] == frame.columns
    rows = found.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in rows) == brute_hits(docs, items)
    for r in rows:
        assert r["n_hit"] == sum(s["stop"] - s["start"] for s in r["hit_spans"])
        assert all(a["stop"] < b["start"] for a, b in zip(r["hit_spans"], r["hit_spans"][1:]))


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", None), ("r", " ")], "item_id string, text string")
    assert [r["n_hit"] for r in decontamination.contamination(docs, items).collect()] == [0, 0]
    assert decontamination.contamination(docs.where("false"), docs.toDF("item_id", "text")).count() == 0
    with pytest.raises(ValueError):
        decontamination.contamination(docs.withColumnRenamed("doc_id", "n_hit"), items, "n_hit")
