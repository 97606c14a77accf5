"""The training-data operators against brute force, and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewarden.llm import jaccard, licenses, lines, mixing, packing, quality, sharding, suffixes, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    base = [words(rng, rng.randint(30, 260)) for _ in range(40)]
    passage = words(rng, 90)
    rows = []
    for i, t in enumerate(base):
        rows.append(t if i % 5 else f"{t[:200]} {passage} {t[200:]}")
    rows += [base[1]] * 6 + ["", "", None, "one", "x\ny\nx", passage, "Licensed under the Apache License, Version 2.0. MIT License"]
    for k in range(12):
        w = base[2].split()
        w[k * 2 % len(w)] = "changed"
        rows.append(" ".join(w))
    rows.append("a" * 900)
    rows = [(i if i % 17 else None, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    rows.append(rows[1])
    return spark.createDataFrame(rows, DOCS).cache(), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_license_scan(corpus):
    df, rows = corpus
    got = Counter((r["text"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(df).collect())
    want = Counter()
    for _, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        hits = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[(t, len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits})))] += 1
    assert got == want
    labels = {r["labels"] for r in licenses.scan(df).collect()}
    assert "apache,apache-2.0,mit" in labels


def test_license_scan_finds_all_templates_of_a_document(spark):
    """Each passage that stands word for word is found, whatever stands beside it."""
    every = [t for _, t, _ in licenses.TEMPLATES]
    rows = [(0, " filler ".join(every)), (1, " filler ".join(reversed(every)))] + [(2 + i, t) for i, t in enumerate(every)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in licenses.scan(df).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[0] and label in got[1] and label in got[2 + i]


def test_sharding(corpus, empty):
    df, rows = corpus
    got = sharding.shard_documents(df, shards=5).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert sharding.shard_documents(empty, shards=5).count() == 0


def test_mixing_stays_within_a_block(spark, empty):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid").alias("source"))
    got = mixing.mix_sources(rows, {"big": 1.0, "mid": 2.0, None: 1.0}, block=10, frame=40).collect()
    assert len(got) == 3000
    slots = sorted({(r["mix_slot"], r["source"]) for r in got}, key=lambda x: x[0])
    assert len({s for s, _ in slots}) == len(slots)
    share = Counter(s for t, s in slots if t < 40)
    seen = Counter()
    for t, s in slots[:40]:
        seen[s] += 1
        assert abs(seen[s] - (t + 1) * share[s] / 40) < 1
    assert mixing.mix_sources(empty).count() == 0


def test_packing_covers_all_tokens(corpus, empty):
    df, rows = corpus
    got = packing.pack(df, max_length=64, buckets=4, budget=256).collect()
    assert sum(r["length"] for r in got) == sum(len((t or "").split()) + 1 for _, t, *_ in rows)
    filled = Counter()
    for r in got:
        assert r["length"] <= r["bucket_length"]
        filled[(r["bucket_length"], r["batch"])] += r["bucket_length"]
    assert max(filled.values()) <= 256
    assert packing.pack(empty).count() == 0


def test_boundaries_are_optimal():
    h = np.array([0, 5, 0, 9, 1, 0, 7, 2])
    cost = lambda ends: sum(h[n] * (min(e for e in ends if e >= n) - n) for n in range(8) if h[n])
    best = min(cost([a, b, 7]) for a in range(1, 8) for b in range(1, 8))
    assert cost(packing.best_boundaries(h, 3)) == best


def test_suffix_dedup(corpus, empty):
    df, rows = corpus
    got = Counter(tuple(r) for r in suffixes.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_passage").collect())
    seen, least = Counter(), suffixes.PASSAGE
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in data:
        for s in range(len(b) - 399):
            seen[b[s : s + 400]] += 1
        for s in range(len(b) - least + 1):
            seen[b[s : s + least]] += 1
    want = Counter()
    for i, b in data:
        cover = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                cover[s : s + 400] = True
        spans = int((cover[1:] & ~cover[:-1]).sum() + (cover[0] if len(b) else 0))
        kept = bytes(x for x, c in zip(b, cover) if not c)
        want[(i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest(), any(seen[b[s : s + least]] > 1 for s in range(len(b) - least + 1)))] += 1
    assert got == want
    assert len({has for *_, has in want}) == 2
    assert suffixes.remove_repeats(empty).count() == 0


def test_line_dedup(spark, empty):
    long = "the quick brown fox jumps over the lazy dog and then it runs far away into the deep dark wood at night " * 2
    near = long.replace("lazy", "sleepy", 1)
    rows = [(1, f"{long}\nfirst own line with many words here"), (2, f"{near}\nshort\n--"), (3, f"{long}\nShort!"), (4, None), (5, ""), (5, ""), (None, "one\ntwo"), (6, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"i1": F.lit(8), "lid": F.lit("x"), "pos": F.col("doc_id"), "a.b": F.lit(1)})
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "i1", "lid", "pos", "a.b", "n_lines", "n_removed"] and {r["i1"] for r in got.collect()} == {8}
    # null ids come first; lines without a word stay
    want = {(1, rows[0][1], 2, 0), (2, "short\n--", 3, 1), (3, "", 2, 2), (4, None, 0, 0), (5, "", 1, 0), (None, "one\ntwo", 2, 0), (6, "", 1, 1)}
    assert {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()} == want and got.count() == 8
    assert lines.dedup_lines(empty).count() == 0
    kept = lines.stage(spark, df, "").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 4, 5, 5]
    with pytest.raises(ValueError):
        lines.dedup_lines(df.withColumn("n_lines", F.lit(1)))


def test_line_dedup_of_repeated_rows(spark):
    """Rows of equal id and text: one keeps its lines, whatever their number."""
    rows = [(1, "one line\nother line")] * 5 + [(None, "a third line\n...")] * 3 + [(2, "other line")]
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, "one line\nother line", 0): 1, (1, "", 2): 4, (None, "a third line\n...", 0): 1, (None, "...", 1): 2, (2, "", 1): 1}


def test_line_dedup_of_documents(spark, monkeypatch):
    """Against brute force, with buckets cut into small blocks."""
    monkeypatch.setattr(lines, "BLOCK", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(30)
    rows = sorted(((str(r["doc_id"]), r["text"] or "") for r in docs.collect()), key=lambda r: r[0])
    at = [(d, k, tuple(re.findall(r"[^\W_]+", line.lower()))) for d, t in rows for k, line in enumerate(t.split("\n"))]
    at = [x for x in at if x[2]]
    low = similar_groups([x[2] for x in at])
    gone = Counter(at[i][0] for i in range(len(at)) if low[i] != i)
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect() if r["n_removed"]} == {int(d): n for d, n in gone.items()}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def similar_groups(rows):
    """For each line the first one of its group: equal, or linked by edit similarity 0.8."""
    low = list(range(len(rows)))
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            most = max(len(x), len(y)) // 5
            if x == y or (abs(len(x) - len(y)) <= most and sum((Counter(x) & Counter(y)).values()) >= max(len(x), len(y)) - most and edits(x, y) <= most):
                pairs.append((a, b))
    while True:
        before = list(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def test_line_dedup_finds_every_similar_line(spark):
    """Groups by brute-force edit similarity of lines of 5 to 100 words with 10 to 25 % of the words changed."""
    rng = random.Random(8)
    rows = []
    for n in [5, 6, 8, 9, 10, 12, 15, 20, 33, 40, 80, 100] * 4:
        base = words(rng, n).split()
        rows.append(base)
        for share in (0.1, 0.2, 0.25):
            w = list(base)
            for _ in range(max(1, int(share * n))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["changed"], [w[k], "added"]])
            rows.append(w)
    rows += [["la"] * 12, ["la"] * 14, ["la"] * 18]

    low = similar_groups([tuple(w) for w in rows])
    df = spark.createDataFrame([(1000 + i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"] - 1000 for r in lines.dedup_lines(df).where("n_removed = 1").collect()}
    assert got == {i for i in range(len(rows)) if low[i] != i} and len(got) > 60


def test_lines_around_one_passage(spark, monkeypatch):
    """Lines with one passage after starts of their own: those with short starts are alike, and few pairs are ever rows."""
    rng = random.Random(5)
    passage, made = words(rng, 40).split(), []
    rows = [[f"own{k}word{i}" for i in range(n)] + passage for n in (5, 6, 7, 8, 9, 12, 14, 16, 18) for k in range(n * 100, n * 100 + 20)]
    low = similar_groups([tuple(w) for w in rows])

    def counted(df, name, save=lines.save):
        out = save(df, name)
        if name in ("pairs", "close"):
            made.append(out.count())
        return out

    monkeypatch.setattr(lines, "save", counted)
    df = spark.createDataFrame([(1000 + i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"] - 1000 for r in lines.dedup_lines(df).where("n_removed = 1").collect()}
    assert got == {i for i in range(len(rows)) if low[i] != i} and len(got) >= 99
    assert max(made) <= 8 * len(rows)


@pytest.mark.parametrize("block", [1000, 50])
def test_lines_that_share_a_pair_by_chance(spark, monkeypatch, block):
    """Of many lines with one common word pair only those that may match another are read and moved again."""
    monkeypatch.setattr(lines, "BLOCK", block)
    rng, made = random.Random(11), Counter()
    rows = [words(rng, k).split() + ["wonderfulpassage", "everyregion"] + words(rng, 4).split() for k in (10, 11, 12, 13, 14) * 40]
    for k in range(20):
        rows += [rows[k][:5] + ["changed"] + rows[k][6:], rows[k][:2] + ["other", "words"] + rows[k][4:]]
    low = similar_groups([tuple(w) for w in rows])

    def counted(df, name, save=lines.save):
        out = save(df, name)
        made[name] = max(made[name], out.count())
        return out

    monkeypatch.setattr(lines, "save", counted)
    df = spark.createDataFrame([(1000 + i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"] - 1000 for r in lines.dedup_lines(df).where("n_removed = 1").collect()}
    assert got == {i for i in range(len(rows)) if low[i] != i} and len(got) >= 40
    assert made["letters"] <= 100 and made["buckets"] >= len(rows)


def test_line_dedup_splits_and_hashes_once(spark):
    """Each line is split into words once for its sketch, and a text hashed before its lines are rows."""
    docs = spark.createDataFrame([(1, "one two\n...\n"), (2, None)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(lines.sketched(docs, "text")).count(r"[^\p{L}\p{N}]+") == 1 and lines.sketched(docs, "text").count() == 1
    found = plan(lines.occurrences(docs, "doc_id", "text"))
    assert found.index("Generate") < found.index("AS i1") and found.index("Generate") < found.index("AS i2")


def test_pairs_that_are_alone_with_their_keys(spark, monkeypatch):
    """Two lines that share many keys with no other line are one pair; only those that may match go on."""
    rng, made = random.Random(8), Counter()
    rows = [words(rng, 40).split() for _ in range(30)]
    rows += [r[:20] + ["changed"] + r[21:] for r in rows[:10]] + [words(rng, 20).split() + r[20:] for r in rows[10:20]]
    low = similar_groups([tuple(w) for w in rows])

    def counted(df, name, save=lines.save):
        out = save(df, name)
        made[name] = max(made[name], out.count())
        return out

    monkeypatch.setattr(lines, "save", counted)
    # all lines of one text, which is read and split once
    df = spark.createDataFrame([(1, "\n".join(" ".join(w) for w in rows))], "doc_id long, text string")
    assert [r["n_removed"] for r in lines.dedup_lines(df).collect()] == [sum(low[i] != i for i in range(len(rows)))] == [10]
    assert made["neighbours"] == 0 and 10 <= made["twos"] <= 20 and made["matching"] == 10


def test_line_sketches(spark):
    """An edit turns two marks at most, and copies of a line are one row."""
    rng = random.Random(2)
    base = words(rng, 60).split()
    rows = [" ".join(base), " ".join(base)] + [" ".join(base[:k] + base[k + 3 :]) for k in range(0, 50, 7)]
    got = lines.sketched(spark.createDataFrame([(t,) for t in rows], "text string"), "text").collect()
    assert len(got) == len(rows) - 1
    first = max(got, key=lambda r: r["n_words"])
    for r in got:
        apart = sum(bin((r[s] ^ first[s]) & (2**64 - 1)).count("1") for s in lines.MARKS)
        assert apart <= 2 * 3 and (r == first or len(set(r["keys"]) & set(first["keys"])) > 0)


def test_very_long_lines(spark):
    """Lines of tens of thousands of words are compared like others."""
    many = " ".join(f"w{i}" for i in range(33_000))
    df = spark.createDataFrame([(1, "x y " * 40_000), (2, "x y " * 40_000), (3, many), (4, many[: many.rindex(" ")])], "doc_id long, text string")
    assert [r["n_removed"] for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == [0, 1, 0, 1]


def test_quality_measures(corpus):
    df, rows = corpus
    got = Counter((r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.measures(df).collect())
    want = Counter()
    for _, t, *_ in rows:
        w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set(), 0
        for line in (t or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        cover = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        want[(t, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))] += 1
    assert got == want


def test_quality_keeps_clean_and_drops_symbols(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 60) if i else " ".join(x + "&&&" for x in words(rng, 60).split()), "en", "s", 0) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    judged = quality.judge(quality.with_keys(quality.measures(df))).select("doc_id", "kept").collect()
    assert {r["doc_id"] for r in judged if not r["kept"]} == {0}


@pytest.mark.parametrize("block", [4_000_000, 700])
def test_jaccard(corpus, empty, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CHARS", block)
    df, rows = corpus
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    linked = jaccard.link(df).collect()
    got = sorted(Counter(r["component"] for r in linked if r["n"]).values())
    assert got == sorted(Counter(find(i) for i in range(len(rows)) if sets[i]).values())
    assert sorted(r["n"] for r in linked) == sorted(map(len, sets))
    assert jaccard.link(empty).count() == 0


@pytest.mark.parametrize("leaf", [2048, 20])
def test_vectors(spark, monkeypatch, leaf):
    monkeypatch.setattr(vectors, "LEAF", leaf)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16)).astype(np.float32)
    x[40:60] = x[3] + rng.normal(size=(20, 16)) * 0.12
    x[70:75] = x[5]
    rows = [(i, [float(v) for v in x[i]], int(i % 2)) for i in range(150)]
    rows += [(150, None, 1), (151, [0.0] * 16, 1), (152, [float("nan")] * 16, 0), (153, [float(v) for v in x[5]], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.link_vectors(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= 0.93) & (np.arange(150)[:, None] % 2 == np.arange(150) % 2) & ~np.eye(150, dtype=bool)
    low = np.arange(150)
    for _ in range(150):
        low = np.minimum(low, np.where(link, low, 999).min(axis=1))
    want = {i: (int(link[i].sum()), int(low[i])) for i in range(150)} | {i: (0, i) for i in range(150, 154)}
    assert got == want


def test_vectors_of_one_direction(spark, monkeypatch):
    """Multiples of one vector link with each other, and the levels of the tree end; an empty table gives none."""
    monkeypatch.setattr(vectors, "LEAF", 40)
    base, far = [0.3, -1.25, 2.5, 0.01], [1.0, 0.0, 0.0, 0.0]
    rows = [(i, [x * (2.0 ** (i % 20) if i < 100 else i) for x in base], 1) for i in range(300)] + [(300, far, 1), (301, base, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.link_vectors(df).collect()}
    assert got == {i: (299, 0) for i in range(300)} | {300: (0, 300), 301: (0, 301)}
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_toxicity_learns_words():
    """Of 160 texts that the fit hasn't seen, every toxic one scores above every other."""
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(640):
        w = words(rng, 120).split()
        if i % 4 == 0:
            for k in range(8):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "vilely", "vilify"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    net, calibration = toxicity.fit(texts[:480], labels[:480])
    import pandas as pd

    frame = pd.DataFrame({"doc_id": range(162), "text": [*texts[480:], "", None]})
    scores = pd.concat(toxicity.scorer(net.p, calibration)([frame]))["score"].to_numpy()
    y = np.array(labels[480:])
    assert scores[:160][y == 1].min() > scores[:160][y == 0].max() and len(scores) == 162


def test_toxicity_reads_windows_by_half_and_long_runs_whole():
    """Any 24 words stand in one window, and characters far into a run without spaces reach the inputs."""
    for n in (49, 72, 73, 200):
        spans = [(s, min(n, s + toxicity.WINDOW)) for s in toxicity.starts(n)]
        assert all(any(a <= k and k + 24 <= b for a, b in spans) for k in range(n - 23))
    run = "".join(random.Random(6).choice("abcdefgh") for _ in range(1000))
    for text in (run[:64], run[:65], run[:80], run[:112], run[:113], run):
        grams = set(toxicity.Rows(toxicity.tokens(text)).flat[1].tolist())
        want = {int(toxicity.Rows([text[i : i + 4]]).flat[1][1]) for i in range(len(text) - 3)}
        assert want <= grams and max(map(len, toxicity.tokens(text))) <= toxicity.LONG


def test_toxicity_rows_and_windows_of_many_words_equal_those_of_each():
    rng = random.Random(7)
    some = ["", "a", "é", "ab", "abcdefghij", "x" * 64, *words(rng, 300).split()]
    rows = toxicity.Rows(some)
    for i, w in enumerate(some):
        own = toxicity.Rows([w])
        assert own.word[0] == rows.word[i]
        for k in (0, 1):
            assert own.flat[k].tolist() == rows.flat[k][rows.at[k][i] : rows.at[k][i] + rows.size[k][i]].tolist()
    begins = lambda w: toxicity.Rows([w]).flat[0].tolist()
    assert begins("abcdefgh")[:4] == begins("abcdexyz")[:4] and begins("abcdefgh")[4] != begins("abcdexyz")[4] and len(begins("abcdefgh")) == 7
    texts = [None, "", "one", " ".join(words(rng, 20) for _ in range(20)), "two one", words(rng, 48), words(rng, 49)]
    found, want = toxicity.Windows(texts), []
    for d, text in enumerate(texts):
        ids = [found.index[w] for w in toxicity.tokens(text)]
        for s in toxicity.starts(len(ids)):
            part = ids[s : s + toxicity.WINDOW]
            want.append([d, *part, *[-1] * (toxicity.WINDOW - len(part))])
    assert np.column_stack([found.doc, found.rows]).tolist() == want
    # a task whose texts are all empty
    import pandas as pd

    empty = pd.DataFrame({"doc_id": [1, 2], "text": ["", None]})
    assert len(pd.concat(toxicity.scorer(toxicity.Network().p, np.zeros(4))([empty]))) == 2


def test_pipeline_and_gradient(spark, tmp_path):
    net = toxicity.Network(1)
    rng = np.random.default_rng(0)
    gates = {d: rng.normal(size=(5, 3, 3 * toxicity.HIDDEN)) for d in "fb"}
    mask = np.ones((5, 3, 1))
    mask[3:, 1] = 0
    y, w = np.array([0.0, 1.0, 1.0]), np.ones(3)
    loss = lambda: -np.mean(y * np.log(toxicity.sigmoid(net.run(gates, mask))) + (1 - y) * np.log(1 - toxicity.sigmoid(net.run(gates, mask))))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g, dg = net.gradients(gates, mask, y, w)
    for d in "fb":
        at = (2, 1, 4)
        gates[d][at] += 1e-4
        up = loss()
        gates[d][at] -= 2e-4
        down = loss()
        gates[d][at] += 1e-4
        assert abs((up - down) / 2e-4 - dg[d][at]) < 1e-3
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "padding" in got.columns
