"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, save, unpacked
from .lines import identity

#: Words of a window that counts as contamination, and words of the grams that fingerprints are taken from.
WINDOW, GRAM = 10, 5
#: Fingerprints that one pass over the documents looks up (about 40 bytes each in memory); more take further passes.
PASS = 1_000_000
#: Bytes of benchmark windows up to which they are broadcast; more are joined by a shuffle of what fingerprints left.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: str) -> Column:
    """Words of a text: runs of digits, letters and all beyond ASCII, with A-Z alone lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _GAP), "")


def winnowed(rows: DataFrame, length: int) -> DataFrame:
    """Add `least`, the fingerprint of every window of `length` words: the least hash of the grams in it.

    rows must have `words`. Two windows of equal words have equal fingerprints, so every shared window is met.
    """
    k = min(GRAM, max(1, (length + 1) // 2))
    w = length - k + 1
    gram = "xxhash64(" + ", ".join(f"hashes[i + {j}]" for j in range(k)) + f", {length})"
    low = "least(" + ", ".join(f"grams[i + {j}]" for j in range(w)) + ")" if w > 1 else "grams[i]"
    each = lambda array, n, body: F.expr(f"if(size({array}) >= {n}, transform(sequence(0, size({array}) - {n}), i -> {body}), cast(array() as array<bigint>))")
    rows = rows.withColumn("hashes", F.expr("transform(words, x -> xxhash64(x))"))
    rows = rows.withColumn("grams", each("hashes", k, gram)).drop("hashes")
    return rows.withColumn("least", each("grams", w, low)).drop("grams")


def benchmark_windows(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(length, win, least, group) of the distinct windows, and (group, item) of the items that hold them; both saved.

    Windows that the same items hold are one group, named by two exclusive-or sums of the items' hashes and their
    number, so that a document meets an item once for each group and not once for each window.
    """
    rows = items.select(F.col(item_id).cast("string").alias("item"), word_list(text).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("length", F.least(F.size("words"), F.lit(WINDOW)))
    places = rows.select("item", "length", "words", F.explode(F.expr("sequence(1, size(words) - length + 1)")).alias("at"))
    held = places.select("length", F.slice("words", F.col("at"), F.col("length")).alias("words"), F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("win"), "item").dropDuplicates(["length", "win", "item"])
    held = save(held, "held")
    name = lambda seed: F.bit_xor(F.xxhash64(F.coalesce("item", F.lit("")), F.col("item").isNull(), F.lit(seed)))
    one = held.groupBy("length", "win").agg(F.first("words").alias("words"), F.struct(name(1).alias("a"), name(2).alias("b"), F.count(F.lit(1)).alias("n")).alias("group"))
    lengths = sorted(r["length"] for r in held.select("length").distinct().collect())  # WINDOW of them at most
    parts = [winnowed(one.where(F.col("length") == n), n).select("length", "win", F.get("least", F.lit(0)).alias("least"), "group") for n in lengths]
    if not parts:
        parts = [one.select("length", "win", F.lit(0).cast("long").alias("least"), "group")]
    windows = save(reduce(DataFrame.unionByName, parts), "windows")
    members = held.join(windows.select("length", "win", "group"), ["length", "win"]).select("group", "item").distinct()
    return windows, save(members, "members")


def occurrences(docs: DataFrame, windows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(i1, i2, start, stop, group): places, from 0, where documents hold a window, `stop` exclusive.

    A document's fingerprint stands for the run of windows that share it. Runs whose fingerprint the benchmark has (a
    broadcast of PASS fingerprints at most) are extended to their windows, whose words are then compared in full.
    Distinct windows are looked up, so a window that many items hold doesn't multiply rows.
    """
    sizes = {r["length"]: r for r in windows.groupBy("length").agg(F.count_distinct("least").alias("n"), F.sum(F.octet_length("win") + 64).alias("bytes")).collect()}
    words = docs.where(F.col(text).isNotNull()).select(*identity(doc_id, text), word_list(text).alias("words"))
    found = []
    for length, size in sizes.items():
        runs = winnowed(words, length)
        runs = runs.withColumn("starts", F.expr("filter(if(size(least) > 0, sequence(0, size(least) - 1), cast(array() as array<int>)), i -> i = 0 or least[i] <> least[i - 1])"))
        # outer: an inferred filter on the array would be pushed below and compute all of this once more for each use
        runs = runs.select("i1", "i2", "words", "least", "starts", F.posexplode_outer("starts").alias("run", "start")).withColumn("key", F.get("least", F.col("start")))
        own = windows.where(F.col("length") == length)
        passes = -(-size["n"] // PASS)
        keys = own.select(F.col("least").alias("key")).distinct()
        wins = own.select("win", "group")
        if size["bytes"] <= BROADCAST_BYTES:
            wins = F.broadcast(wins)
        for i in range(passes):
            some = keys.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(passes)) == i) if passes > 1 else keys
            hit = runs.join(F.broadcast(some), "key", "left_semi")
            end = F.coalesce(F.get("starts", F.col("run") + 1), F.size("least"))
            at = hit.select("i1", "i2", "words", F.explode(F.sequence(F.col("start"), end - 1)).alias("start"))
            whole = at.select("i1", "i2", "start", F.array_join(F.slice("words", F.col("start") + 1, F.lit(length)), " ").alias("win")).join(wins, "win")
            found.append(whole.select("i1", "i2", "start", (F.col("start") + length).alias("stop"), "group"))
    if not found:
        return words.select("i1", "i2", F.lit(0).alias("start"), F.lit(0).alias("stop"), F.expr("cast(null as struct<a:bigint,b:bigint,n:bigint>)").alias("group")).where("false")
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, hit_spans, items and contaminated.

    A window is WINDOW consecutive words of an item, or all words of a shorter one. A document word is hit when it
    lies in any occurrence of a window in the document; hit_spans are the maximal runs of hit words (words from 0,
    `stop` exclusive), items the ids, as text and in order, of the items with an occurring window. Every shared window is
    found: equal windows have equal fingerprints, and found windows are compared word by word.

    Null and empty texts have no words. Items with a null id mark words but are not listed; items of equal id are
    one item. Repeated documents each get the same values. Other columns of docs pass through whatever their names;
    columns of docs that are named like a result column would clash and are an error. Documents of any length are read
    whole; what is gathered for one document grows with its own words, and its list of items with the items it holds.
    """
    added = ["n_words", "n_hit", "hit_spans", "items", "contaminated"]
    if taken := set(added) & set(docs.columns):
        raise ValueError(f"the result has columns of its own named {sorted(taken)}")
    windows, members = benchmark_windows(items, item_id, item_text)
    hits = save(occurrences(docs, windows, doc_id, text).groupBy("i1", "i2").agg(F.collect_set(F.struct("start", "stop")).alias("places"), F.collect_set("group").alias("groups")), "hits")
    places = hits.select("i1", "i2", F.expr("array_sort(array_distinct(flatten(transform(places, p -> sequence(p.start, p.stop - 1)))))").alias("at"))
    first, last = (F.expr(f"filter(at, (p, i) -> coalesce(get(at, i {step} 1) <> p {step} 1, true))") for step in "-+")
    spans = places.select("i1", "i2", F.size("at").alias("n_hit"), first.alias("firsts"), last.alias("lasts"))
    spans = spans.select("i1", "i2", "n_hit", F.expr("transform(firsts, (p, i) -> struct(p as start, lasts[i] + 1 as stop))").alias("hit_spans"))
    named = hits.select("i1", "i2", F.explode("groups").alias("group")).join(members.where("item is not null"), "group").groupBy("i1", "i2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = save(spans.join(named, ["i1", "i2"], "left"), "told")
    rows = docs.select(packed(docs).alias("d"), *identity(doc_id, text), F.size(word_list(text)).cast("long").alias("n_words")).join(told, ["i1", "i2"], "left")
    no_spans, no_items = F.expr("cast(array() as array<struct<start:int,stop:int>>)"), F.expr("cast(array() as array<string>)")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(*unpacked(docs, "d"), "n_words", n_hit.alias("n_hit"), F.coalesce("hit_spans", no_spans).alias("hit_spans"), F.coalesce("items", no_items).alias("items"), (n_hit > 0).alias("contaminated"))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0) x) y),
dw AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) l WHERE len(w) >= n) x),
m AS (SELECT DISTINCT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON iw.win = dw.win AND iw.n = dw.n),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) x GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""
