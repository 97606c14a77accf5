"""Jaccard join on word 5-grams by T-occurrence search, long lists apart."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, save, stage_of
from .suffixes import Rolling

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

WORDS, NUM, DEN = 5, 75, 100
#: Part of a set's size by which its list of looked-up shingles is longer than one common shingle needs, in percent.
EXTRA = 7
#: Most keys that are broadcast to fetch texts or drop rows.
BROADCAST_KEYS = 1_000_000
_TOKEN_BITS = np.uint64(48)
#: Characters of text that a block of a candidate group holds, about.
BLOCK_CHARS = 4_000_000


def shingles(text: str | None, rolling: Rolling, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of all words as one when there are fewer."""
    body = b" ".join((text or "").encode("utf-8", "replace").lower().split())  # bytes: A-Z and ASCII spaces alone
    if not body:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(body, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    if len(starts) <= words:
        start, end = starts[:1], ends[-1:]
    else:
        start, end = starts[: 1 - words], ends[words - 1 :]
    return np.unique(rolling.of(rolling.prefix(data), start, end))


def overlap_needed(n: int) -> int:
    """Least number of its shingles that a set of n shares with any set that it links to."""
    return -(-NUM * n // DEN)


def extra(n: int) -> int:
    return 1 + EXTRA * n // 100


def set_id(hashes: np.ndarray) -> int:
    """Hash of the whole set."""
    if not len(hashes):
        return 0
    k = Rolling.mixed(np.cumsum(Rolling.mixed(hashes), dtype=np.uint64)[-1:] + np.uint64(len(hashes)))
    return int(k.view(np.int64)[0])


def describe(batches):
    rolling = Rolling(21)
    for batch in batches:
        sets = [shingles(t, rolling) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "tkey": batch["tkey"], "cls": [set_id(s) for s in sets], "n": [len(s) for s in sets]})


def lookups(batches):
    """(token, cls): the first shingles of each set in hash order, n - ceil(0.75 n) + extra(n) of them.

    Sets that link share min(extra) of these at least. Equal sets of a batch are given once, and the classes of a
    token of a batch in one row, so a very frequent shingle makes few rows.
    """
    rolling = Rolling(21)
    for batch in batches:
        seen, tokens, owners = set(), [], []
        for text in batch["text"]:
            s = shingles(text, rolling)
            c = set_id(s)
            if not len(s) or c in seen:
                continue
            seen.add(c)
            part = s[: min(len(s), len(s) - overlap_needed(len(s)) + extra(len(s)))]
            tokens.append((part >> (np.uint64(64) - _TOKEN_BITS)).view(np.int64))
            owners.append(np.full(len(part), c))
        if not tokens:
            continue
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        distinct, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        yield pd.DataFrame({"token": tokens[~shared], "cls": owners[~shared], "more": None})
        if shared.any():
            grouped = pd.DataFrame({"token": tokens[shared], "cls": owners[shared]}).groupby("token")["cls"].agg(list).reset_index()
            grouped["more"] = [x[1:] for x in grouped["cls"]]
            grouped["cls"] = [x[0] for x in grouped["cls"]]
            yield grouped[["token", "cls", "more"]]


def probe(batches):
    """Keep pairs whose texts share enough: each shingle of the smaller set is searched in the larger one."""
    rolling = Rolling(21)
    for batch in batches:
        keep, last, held = [], None, None
        for ta, tb, b in zip(batch["ta"], batch["tb"], batch["b"]):
            if b != last:
                last, held = b, shingles(tb, rolling)
            one, two = shingles(ta, rolling), held
            if len(one) > len(two):
                one, two = two, one
            both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
            keep.append(DEN * both >= NUM * (len(one) + len(two) - both))
        yield batch[["a", "b"]][np.array(keep, bool)]


class Lists:
    """Inverted lists over the sets of a block."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")  # owners ascend within a token
        self.owner = owner[order]
        self.token, self.at = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.at[1:], len(order))
        self.size = np.array([len(s) for s in sets], np.int64)

    def find(self, query: np.ndarray) -> np.ndarray:
        """Sets that link to the query, by DivideSkip.

        A linking set shares T = overlap_needed() shingles at least. The L longest lists stay apart; the others are
        merged, and sets that occur T - L times or more in them are searched in the long ones by binary probes.
        """
        where = np.minimum(np.searchsorted(self.token, query), max(0, len(self.token) - 1))
        where = where[self.token[where] == query] if len(self.token) else where[:0]
        need = overlap_needed(len(query))
        if len(where) < need:
            return where[:0]
        length = self.end[where] - self.at[where]
        where = where[np.argsort(length, kind="stable")]
        apart = min(need - 1, int(need / (0.01 * np.log2(2 + length.max()) * len(self.size) ** 0.5 + 1)))
        short, long_ = where[: len(where) - apart], where[len(where) - apart :]
        n = self.end[short] - self.at[short]
        ids = self.owner[np.repeat(self.at[short] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        counts = np.bincount(ids, minlength=len(self.size))
        found = np.flatnonzero(counts >= need - apart)
        both = counts[found]
        for w in long_:
            row = self.owner[self.at[w] : self.end[w]]
            both = both + (row[np.minimum(np.searchsorted(row, found), len(row) - 1)] == found)
        return found[DEN * both >= NUM * (len(query) + self.size[found] - both)]


def search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the queries and the members of a block pair, as many as connect their components."""
    rolling = Rolling(21)
    queries, members = pdf[pdf["query"]], pdf[~pdf["query"]]
    lists = Lists([shingles(t, rolling) for t in members["text"]])
    cls, component = members["cls"].to_numpy(), members["component"].to_numpy()
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for text, c, own in zip(queries["text"], queries["cls"], queries["component"]):
        for k in lists.find(shingles(text, rolling)):
            a, b = top(own), top(component[k])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((c, cls[k]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def describe_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tkey, cls, n) of each row, saved."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    kept = rows.mapInPandas(describe, "doc_id long, tkey long, cls long, n long")
    return save(kept, "sets")


def texts_of(classes: DataFrame, sets: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(cls, text): one text of each class; saved."""
    keys = save(sets.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("tkey").alias("tkey")), "wanted")
    few = keys.count() <= BROADCAST_KEYS
    body = docs.select(F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    return save(body.join(F.broadcast(keys) if few else keys, "tkey").dropDuplicates(["cls"]).select("cls", "text"), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link; saved."""
    one = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    return save(both.select("a", "b", "ta", "tb").mapInPandas(probe, "a long, b long"), "verified")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tkey, cls, n, component): rows with the least class id of their connected group.

    Two sets link when 100 * intersection >= 75 * union. Equal sets are one class. A class looks up its first
    shingles in hash order, enough that two that link share `extra` of them (see lookups()). Classes fewer of whose
    lookups stand elsewhere than that leave. Of what is left the longest lists are set apart, as many as may be
    missed, and the short ones are merged by token: each short list has a hub, the class with the most frequent
    lookups, and the classes of a hub's lists are its group, so classes that may link share a group. A group's
    members are compared with the hub first. Those that do not join it are then searched among all members by
    DivideSkip over inverted lists of whole sets, in blocks of bounded text, so a group of any size is spread over
    block pairs. Nothing is capped: any link between different sets is found or implied by others.
    """
    spark = docs.sparkSession
    sets = describe_rows(docs, doc_id, text)
    classes = sets.where("n > 0").groupBy("cls").agg(F.max("n").alias("n"))
    rows = docs.select(F.col(text).alias("text")).mapInPandas(lookups, "token long, cls long, more array<long>")
    by = Window.partitionBy("token")
    count = F.sum(1 + F.coalesce(F.size("more"), F.lit(0))).over(by)
    low = F.min(F.least("cls", F.array_min("more"))).over(by)
    high = F.max(F.greatest("cls", F.array_max("more"))).over(by)
    lists = rows.withColumn("df", count).withColumn("lo", low).withColumn("hi", high).where("lo < hi")
    lists = lists.select("token", "df", F.explode(F.concat(F.array("cls"), F.coalesce("more", F.array().cast("array<long>")))).alias("cls"))
    lists = save(lists, "lists")
    enough = F.floor(F.lit(NUM) * (1 + F.floor(F.lit(EXTRA) * F.col("n") / 100)) / DEN)
    lists = lists.dropDuplicates(["cls", "token"]).join(classes, "cls").withColumn("need", F.greatest(F.lit(1), enough))
    own = Window.partitionBy("cls")
    ranked = lists.withColumn("hits", F.count(F.lit(1)).over(own)).withColumn("weight", F.sum("df").over(own))
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy("df", "token"))).where("hits >= need and rank <= hits - need + 1")
    ranked = ranked.withColumn("size", F.count(F.lit(1)).over(by)).withColumn("hub", F.max(F.struct("weight", "cls")).over(by)).where("size > 1")
    groups = save(ranked.select(F.col("hub.cls").alias("hub"), "cls").distinct(), "groups")
    texts = texts_of(groups.select("cls").distinct(), sets, docs, text)
    edges = verified(groups.where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")), texts)
    found = save(components(edges, spark), "components")
    name = lambda df, c, as_: df.join(found.select(F.col("node").alias(c), F.col("component").alias(as_)), c, "left").withColumn(as_, F.coalesce(as_, c))
    members = name(name(groups, "cls", "component"), "hub", "hub_component").join(texts.select("cls", F.length("text").alias("chars")), "cls")
    sizes = members.groupBy("hub").agg(F.ceil(F.sum("chars") / BLOCK_CHARS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"), F.count_if(F.col("component") != F.col("hub_component")).alias("away"))
    # a group of two, or with all but the hub's own, is settled
    members = members.join(sizes.where("size > 2 and away > 0"), "hub").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    members = save(members.select("hub", "cls", "component", "blocks", "block", (F.col("component") != F.col("hub_component")).alias("away")), "members")
    asking = members.where("away").select("hub", F.col("block").alias("i")).distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    queries = members.where("away").select("hub", F.col("block").alias("i"), every.alias("j"), "cls", "component", F.lit(True).alias("query"))
    index = members.join(asking, "hub").select("hub", "i", F.col("block").alias("j"), "cls", "component", F.lit(False).alias("query"))
    tasks = queries.unionByName(index).join(texts, "cls")
    more = save(tasks.groupBy("hub", "i", "j").applyInPandas(lambda pdf: search(pdf), "a long, b long"), "more")
    found = save(components(edges.unionByName(more), spark), "components")
    return save(sets.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "linked")


def op8(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts have no shingles and are their own component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    linked = link(docs)
    first = linked.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    joined = linked.join(first, "component", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


@stage_of
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of least (doc_id, text hash); documents without words all stay."""
    linked = link(docs)
    best = linked.where("n > 0").groupBy("component").agg(F.min(F.struct("doc_id", "tkey")).alias("best"))
    gone = linked.where("n > 0").join(best, "component").where(~F.struct("doc_id", "tkey").eqNullSafe(F.col("best"))).select("doc_id", "tkey").distinct()
    gone = save(gone, "gone")
    few = gone.count() <= BROADCAST_KEYS
    gone = F.broadcast(gone) if few else gone
    rows = docs.withColumn("_t", F.xxhash64("text"))
    kept = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["_t"] == gone["tkey"]), "left_anti")
    twice = save(linked.where("n > 0").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    same = kept["doc_id"].eqNullSafe(twice["doc_id"]) & (kept["_t"] == twice["tkey"])
    once = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_t"])
    return kept.join(twice, same, "left_anti").unionByName(once).select(*docs.columns)
