"""Ranked lexical search: exact inner products by sparse ball trees."""

from __future__ import annotations

import heapq
import re
import sys
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Documents that an item gets.
BEST = 10
#: Bytes of item texts in a block; what is broadcast (terms, weights, queries) and a tree's centroids follow from it.
BLOCK_BYTES = 512 << 10
#: Documents of a tree, stored entries of a tree, documents of a leaf.
TREE, ENTRIES, LEAF = 8192, 1_000_000, 128

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

VECTORS = "doc_id long, has_id boolean, n long, terms array<int>, tfs array<long>"
PLACED = "doc_id long, has_id boolean, terms array<int>, vals array<long>, first int, second int, copy long"
TREES = "doc_ids array<long>, has_ids array<boolean>, offsets array<int>, terms array<int>, vals array<long>, starts array<int>, stops array<int>, parents array<int>, leaf array<boolean>, radii array<double>, c_offsets array<int>, c_terms array<int>, c_vals array<double>"


def lowered(text: str):
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


def ragged(lists: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else [], kind))


def term_vectors(docs: DataFrame, numbers: dict[str, int], doc_id: str, text: str) -> DataFrame:
    """For each document with a term: the number of its terms, and those that the items ask for with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches):
        number = shared.value.get
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                found = _TERM.findall(text.as_py())
                if not found:
                    continue
                held = Counter(map(number, found))
                held.pop(None, None)
                ids.append(k)
                sizes.append(len(found))
                order = sorted(held)
                terms.append(np.array(order, np.int32))
                tfs.append(np.array([held[t] for t in order], np.int64))
            ids = batch.column(0).take(pa.array(ids, pa.int64()))
            columns = [ids.fill_null(0), ids.is_valid(), pa.array(sizes, pa.int64()), ragged(terms, pa.int32()), ragged(tfs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "has_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), lowered(text).alias("t")).mapInArrow(count, VECTORS)


def impacts(terms, tfs, m: int, weights: np.ndarray) -> np.ndarray:
    """What a document adds to a score for one occurrence of each of its terms in an item; whole numbers."""
    tfs = np.asarray(tfs, np.int64)
    return weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


def placed(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Documents as sparse vectors of their terms' impacts, with their two largest components to sort like by like."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches):
        w = shared.value
        for batch in batches:
            first, second, vals = [], [], []
            for n, terms, tfs in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                terms = terms.values.to_numpy()
                v = impacts(terms, tfs.values.to_numpy(), 25 + (75 * n * n_docs) // n_terms, w)
                top = np.argsort(-v, kind="stable")[:2]
                first.append(int(terms[top[0]]))
                second.append(int(terms[top[-1]]))
                vals.append(v)
            copy = np.arange(len(vals), dtype=np.int64) * 2654435761 % 2**31  # parts equal vectors
            columns = [batch.column(0), batch.column(1), batch.column(3), ragged(vals, pa.int64()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(copy)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "has_id", "terms", "vals", "first", "second", "copy"])

    return vectors.where("size(terms) > 0").mapInArrow(weigh, PLACED)


class Rows:
    """Sparse rows: entries of row i are terms and vals from offsets[i] to offsets[i + 1]; no row is empty."""

    def __init__(self, offsets, terms, vals) -> None:
        self.offsets, self.terms, self.vals = np.asarray(offsets, np.int64), terms, vals

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[rows] - ends + sizes, sizes)
        return Rows(np.concatenate([[0], ends]), self.terms[at], self.vals[at])

    def sums(self, entries: np.ndarray) -> np.ndarray:
        return np.add.reduceat(entries, self.offsets[:-1])

    def away(self, point: np.ndarray) -> np.ndarray:
        """Squared distances to a dense point, never too small: rounding is added."""
        vals = self.vals.astype(np.float64)
        at = point[self.terms]
        total, own = float(point @ point), self.sums(vals * vals)
        return np.maximum(0.0, total - self.sums(at * at) + self.sums((vals - at) ** 2)) + 1e-11 * (total + own)


def ball_tree(ids, has, rows: Rows, n_terms: int) -> dict:
    """One tree as arrays. Nodes stand before their children and cover documents from starts to stops; leaves are small.

    A node is split between the document farthest from its centroid and the one farthest from that; documents that
    coincide are halved.
    """
    order, nodes, stack = np.arange(len(ids)), [], [(0, len(ids), -1)]
    while stack:
        start, stop, parent = stack.pop()
        own = order[start:stop]
        part = rows.take(own)
        center = np.bincount(part.terms, part.vals.astype(np.float64), n_terms) / len(own)
        away = part.away(center)
        leaf = len(own) <= LEAF
        nodes.append((start, stop, parent, leaf, float(np.sqrt(away.max())) * (1 + 1e-9), center))
        if leaf:
            continue
        point = np.zeros(n_terms)

        def to(k: int) -> np.ndarray:
            at = slice(part.offsets[k], part.offsets[k + 1])
            point[part.terms[at]] = part.vals[at]
            out = part.away(point)
            point[part.terms[at]] = 0
            return out

        one = to(int(away.argmax()))
        near = one <= to(int(one.argmax()))
        if not 0 < near.sum() < len(own):
            near = np.arange(len(own)) < len(own) // 2
        order[start:stop] = np.concatenate([own[near], own[~near]])
        middle, k = start + int(near.sum()), len(nodes) - 1
        stack += [(middle, stop, k), (start, middle, k)]
    kept = rows.take(order)
    held = [np.flatnonzero(n[5]) for n in nodes]
    return {
        "doc_ids": ids[order], "has_ids": has[order], "offsets": kept.offsets, "terms": kept.terms, "vals": kept.vals,
        "starts": [n[0] for n in nodes], "stops": [n[1] for n in nodes], "parents": [n[2] for n in nodes], "leaf": [n[3] for n in nodes], "radii": [n[4] for n in nodes],
        "c_offsets": np.concatenate([[0], np.cumsum([len(h) for h in held])]), "c_terms": np.concatenate(held), "c_vals": np.concatenate([n[5][h] for n, h in zip(nodes, held)]),
    }


def trees(docs: DataFrame, n_terms: int) -> DataFrame:
    """The index: a row for each tree of up to TREE documents of a partition."""

    def built(parts: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        terms, vals = (table.column(c).combine_chunks() for c in ("terms", "vals"))
        offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        made = ball_tree(table.column("doc_id").to_numpy(), table.column("has_id").to_numpy(), Rows(offsets, terms.flatten().to_numpy(), vals.flatten().to_numpy()), n_terms)
        kinds = {"array<long>": pa.int64(), "array<boolean>": pa.bool_(), "array<int>": pa.int32(), "array<double>": pa.float64()}
        fields = [f.split(" ") for f in TREES.split(", ")]
        return pa.RecordBatch.from_arrays([ragged([np.asarray(made[name])], kinds[kind]) for name, kind in fields], [name for name, _ in fields])

    def build(batches):
        parts, n, entries = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = min(TREE - n, batch.num_rows - at)
                sizes = np.cumsum(batch.column("terms")[at : at + room].value_lengths().to_numpy())
                room = max(1, int(np.searchsorted(sizes, ENTRIES - entries, side="right")))
                room = min(room, batch.num_rows - at)
                parts.append(batch.slice(at, room))
                at, n, entries = at + room, n + room, entries + int(sizes[room - 1])
                if n >= TREE or entries >= ENTRIES:
                    yield built(parts)
                    parts, n, entries = [], 0, 0
        if parts:
            yield built(parts)

    return docs.mapInArrow(build, TREES)


def better(score, has, doc_id):
    """Order of results: higher score, then smaller id, ids that are null last."""
    return np.lexsort((doc_id, ~has, -score))


class Search:
    """The best documents so far of each query of a block, over one tree after another."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, best: int) -> None:
        self.queries, self.n_terms, self.k = queries, n_terms, best
        self.least = [1] * len(queries)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)

    def visit(self, tree: dict) -> None:
        rows = Rows(tree["offsets"], tree["terms"], tree["vals"])
        nodes = len(tree["starts"])
        centers = np.zeros((nodes, self.n_terms))
        centers[np.repeat(np.arange(nodes), np.diff(tree["c_offsets"])), tree["c_terms"]] = tree["c_vals"]
        children = [[] for _ in range(nodes)]
        for k, p in enumerate(tree["parents"]):
            if p >= 0:
                children[p].append(k)
        asked = np.zeros(self.n_terms, np.int64)
        for q, (terms, counts) in enumerate(self.queries):
            # <q, d> <= <q, c> + |q| r for all d of a ball, q without the terms that no d has; more for rounding
            asks = centers[:, terms]
            bound = (asks @ counts + np.sqrt((asks > 0) @ (counts.astype(np.float64) ** 2)) * tree["radii"]) * (1 + 1e-9) + 1
            if bound[0] < self.least[q]:
                continue
            asked[terms] = counts
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= self.least[q]:
                top, node = heapq.heappop(heap)
                if tree["leaf"][node]:
                    self.score(q, tree, rows, tree["starts"][node], tree["stops"][node], asked)
                for child in children[node]:
                    if bound[child] >= self.least[q]:
                        heapq.heappush(heap, (max(top, -bound[child]), child))
            asked[terms] = 0

    def score(self, q: int, tree: dict, rows: Rows, start: int, stop: int, asked: np.ndarray) -> None:
        offsets = rows.offsets[start : stop + 1]
        at = slice(offsets[0], offsets[-1])
        scores = np.add.reduceat(rows.vals[at] * asked[rows.terms[at]], offsets[:-1] - offsets[0])
        hit = np.flatnonzero(scores >= self.least[q])
        if not len(hit):
            return
        new = (scores[hit], tree["has_ids"][start + hit], tree["doc_ids"][start + hit])
        score, has, ids = (np.concatenate(x) for x in zip(self.found[q], new))
        keep = better(score, has, ids)[: self.k]
        self.found[q] = score[keep], has[keep], ids[keep]
        if len(keep) == self.k:
            self.least[q] = int(score[keep[-1]])


def searched(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, best: int) -> DataFrame:
    """(query, has_id, doc_id, score): the best documents of each query in each partition of the index."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches):
        state = Search(shared.value, n_terms, best)
        for batch in batches:
            for k in range(batch.num_rows):
                state.visit({name: batch.column(name)[k].values.to_numpy(zero_copy_only=False) for name in batch.schema.names})
        out = [(np.full(len(s), q, np.int32), h, d, s) for q, (s, h, d) in enumerate(state.found)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query", "has_id", "doc_id", "score"])

    return index.mapInArrow(search, "query int, has_id boolean, doc_id long, score long")


def rank_block(docs: DataFrame, rows: list, doc_id: str, text: str, best: int) -> DataFrame | None:
    """Best documents of a block of items (rid, text), or None when no item has a term that a document holds."""
    spark, terms = docs.sparkSession, {}
    asked = [Counter(_TERM.findall(r["t"])) for r in rows]
    for c in asked:
        for t in c:
            terms.setdefault(t, len(terms))
    if not terms:
        return None
    vectors = save(term_vectors(docs, terms, doc_id, text), "vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    held = np.zeros(len(terms), np.int64)
    for t, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # terms of the block at most
        held[t] = n
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
    n_rows = vectors.where("size(terms) > 0").count()
    parts = max(1, -(-n_rows // TREE))
    docs_placed = placed(vectors, weights, n_docs, n_terms).repartitionByRange(parts, "first", "second", "copy")
    index = save(trees(docs_placed, len(terms)), "trees")
    discard(vectors)
    queries = [(np.array([terms[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in asked]
    found = searched(index, queries, len(terms), best)
    found = save(top(found, "query", best), "found")
    discard(index)
    names = spark.createDataFrame([(q, r["rid"]) for q, r in enumerate(rows)], "query int, rid long")
    return found.join(F.broadcast(names), "query").select("rid", "rank", F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "score")


def top(found: DataFrame, key: str, best: int) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("has_id").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best)


def rank_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of each item with a score above 0.

    Terms are runs of digits, letters and all beyond ASCII, A-Z lower-cased. A term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n terms has m = 25 + (75 n N) div L, and its score is the
    sum, over an item's terms with repeats, of w * ((10^9 tf) div (1000 tf + 8 m)). That is the inner product of
    the item's counts with the document's sparse vector of whole numbers. Statistics are taken over all documents.

    Documents alike in their largest components share a partition and there a tree of balls. A ball's centroid and
    radius bound the products of all its documents, with rounding on the safe side; an item descends into balls
    best-first and only while a ball may hold a score that is not below its last kept one, and leaves are scored in
    whole numbers. Results are exact whatever the bounds prune; each partition gives `best` rows an item at most.

    Items are searched in blocks of BLOCK_BYTES of text (their terms and weights are all that is broadcast), a pass
    over the documents a block. Equal scores go by smaller id, null ids last. Null and empty texts have no terms and
    are not counted in N; repeated documents and items are rows of their own. Other columns are not read.
    """
    rows = save(items.select(F.monotonically_increasing_id().alias("rid"), F.col(item_id).alias("item_id"), lowered(item_text).alias("t")), "items")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, found = max(1, -(-size // BLOCK_BYTES)), []
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).select("rid", "t").orderBy("rid").collect()  # about BLOCK_BYTES
        if block and (part := rank_block(docs, block, doc_id, text, best)) is not None:
            found.append(part)
    if not found:
        none = F.lit(None).cast("long")
        return rows.where("false").select("item_id", none.cast("int").alias("rank"), none.alias("doc_id"), none.alias("score"))
    return reduce(DataFrame.unionByName, found).join(rows.select("rid", "item_id"), "rid").select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
q AS (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS t FROM benchmark),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
qt AS (SELECT k, item_id, term, count(*)::BIGINT AS c FROM (SELECT k, item_id, unnest(t) AS term FROM q) x GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) x WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term),
v AS (SELECT r, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS x FROM tf JOIN w ON w.term = tf.term, s),
p AS (SELECT k, item_id, r, doc_id, sum(c * x)::BIGINT AS score FROM qt JOIN v ON v.term = qt.term GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id)::INT AS rank FROM p WHERE score > 0) x WHERE rank <= {BEST}
"""
