"""Hard-negative mining: windowed inner-product search by cover trees over norm-augmented vectors."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save
from .ranking import ragged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Positives of an anchor, negatives of a positive, and the share of the positive's score, in hundredths, that they keep.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Centers that deal the vectors of a label, vectors of a tree, of a leaf, most children of a node, anchors of a block.
SPREAD, TREE, LEAF, FAN, ANCHORS = 32, 4096, 128, 64, 16_384

TREES = "label long, dim int, ids array<long>, x array<double>, starts array<int>, stops array<int>, parents array<int>, leaf array<boolean>, radii array<double>, centers array<int>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def matrix(values, dim: int) -> np.ndarray:
    """Whole numbers floor(256 x), as doubles."""
    return np.floor(256.0 * values.to_numpy(zero_copy_only=False)).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Inner products in whole numbers, as doubles where all are small enough; an error when one needs over 64 bits."""
    if small:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return (whole(a) @ whole(b).T).astype(np.int64)


def nearest(batches):
    """The center of its label that each vector is dealt to."""
    for batch in batches:
        frame, pick = batch.select(["label", "dim"]).to_pandas(), np.zeros(batch.num_rows, np.int32)
        for (_, dim), at in frame.groupby(["label", "dim"]).indices.items():
            if dim:
                x = matrix(batch.column("v").take(pa.array(at)).flatten(), dim)
                c = matrix(batch.column("c")[int(at[0])].values, dim)
                pick[at] = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("vec_id", "label", "dim", "v")], pa.array(pick)], ["vec_id", "label", "dim", "v", "pick"])


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Order of the points, and nodes (start, stop, parent, leaf, radius, center), parents first.

    Points get one coordinate more, so that all have the longest one's norm and inner products order them by distance.
    A child covers points within half its parent's radius of its center, a point of its own, where FAN children can;
    a node's center is also its first child's. Radii are the measured ones. Points that coincide are halved.
    """
    norms = (x * x).sum(axis=1)
    point = np.hstack([x, np.sqrt(np.maximum(0.0, norms.max() - norms))[:, None]])
    order, nodes, stack = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while stack:
        start, stop, parent, center = stack.pop()
        own = order[start:stop]
        away = np.sqrt(((point[own] - point[center]) ** 2).sum(axis=1))
        radius, leaf = float(away.max()), len(own) <= LEAF
        nodes.append((start, stop, parent, leaf, radius * (1 + 1e-9), center))
        if leaf:
            continue
        owner, centers = np.zeros(len(own), np.int64), [center]
        while away.max() > radius / 2 and len(centers) < FAN:
            far = own[int(away.argmax())]
            d = np.sqrt(((point[own] - point[far]) ** 2).sum(axis=1))
            owner[d < away] = len(centers)
            away = np.minimum(away, d)
            centers.append(far)
        if (owner == owner[0]).all():
            owner, centers = (np.arange(len(own)) >= len(own) // 2).astype(np.int64), [center, center]
        order[start:stop] = own[np.argsort(owner, kind="stable")]
        at, k = start, len(nodes) - 1
        for j, n in enumerate(np.bincount(owner, minlength=len(centers))):
            if n:
                stack.append((at, at + n, k, centers[j]))
            at += n
    return order, nodes


def build(batches):
    """Trees of up to TREE vectors of one label and length, from rows sorted by them."""

    def built(label: int, dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order, nodes = cover_tree(x)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts, stops, parents, leaf, radii, centers = zip(*nodes)
        values = [[label], [dim], ids[order], x[order].ravel(), starts, stops, parents, leaf, radii, place[list(centers)]]
        fields = [f.split(" ") for f in TREES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[kind]) if kind in _KINDS else ragged([np.asarray(v)], _KINDS[kind[6:-1]]) for (_, kind), v in zip(fields, values)], [n for n, _ in fields])

    key, ids, xs = None, [], []
    for batch in batches:
        labels, dims, vec_ids = (batch.column(c).to_numpy() for c in ("label", "dim", "vec_id"))
        cuts = np.flatnonzero((np.diff(labels) != 0) | (np.diff(dims) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b <= a:
                continue
            new = (int(labels[a]), int(dims[a]))
            for at in range(a, b, TREE):
                end = min(b, at + TREE)
                if key is not None and (new != key or sum(map(len, ids)) + end - at > TREE):
                    yield built(*key, np.concatenate(ids), np.concatenate(xs))
                    ids, xs = [], []
                key = new
                ids.append(vec_ids[at:end])
                xs.append(matrix(batch.column("v")[at:end].flatten(), new[1]) if new[1] else np.zeros((end - at, 0)))
    if ids:
        yield built(*key, np.concatenate(ids), np.concatenate(xs))


class Windows:
    """The best k vectors so far of each window (anchor, low, high), over one tree after another."""

    def __init__(self, anchors: dict, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.anchors, self.own, self.low, self.high, self.k = anchors, own, low.copy(), high, k
        self.n = np.zeros(len(own), np.int64)
        self.score, self.ids = np.zeros((len(own), k), np.int64), np.zeros((len(own), k), np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates; a full window's lower end rises to its last score, which ties may still share."""
        hit = np.unique(window)
        held = np.arange(self.k) < self.n[hit, None]
        window = np.concatenate([np.broadcast_to(hit[:, None], held.shape)[held], window])
        score, ids = np.concatenate([self.score[hit][held], score]), np.concatenate([self.ids[hit][held], ids])
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        keep = rank < self.k
        window, rank, score, ids = window[keep], rank[keep], score[keep], ids[keep]
        self.score[window, rank], self.ids[window, rank] = score, ids
        self.n[hit] = np.bincount(np.searchsorted(hit, window), minlength=len(hit))
        full = hit[self.n[hit] == self.k]
        self.low[full] = self.score[full, -1]

    def best(self) -> list[np.ndarray]:
        """Window, id and score of all that was kept."""
        held = np.arange(self.k) < self.n[:, None]
        return [np.nonzero(held)[0], self.ids[held], self.score[held]]

    def visit(self, tree: dict, among: np.ndarray) -> None:
        """Search a tree for the windows `among`."""
        x, starts, stops, centers, radii = (tree[c] for c in ("x", "starts", "stops", "centers", "radii"))
        who, at = np.unique(self.own[among], return_inverse=True)
        q = self.anchors["x"][who]
        total = (q * q).sum(axis=1) + (x * x).sum(axis=1).max()
        slack = total * 1e-9 + 1
        nodes = len(starts)
        upper, lower = np.full((len(who), nodes), -np.inf), np.full((len(who), nodes), np.inf)
        children = [[] for _ in range(nodes)]
        for k, p in enumerate(tree["parents"]):
            if p >= 0:
                children[p].append(k)

        def wanted(node_of: np.ndarray) -> np.ndarray:
            """Whether the windows, with a node each, may hold vectors of it that count."""
            return (upper[at, node_of] >= self.low[among]) & (lower[at, node_of] <= self.high[among])

        def bound(rows: np.ndarray, which: list[int], parent: int | None) -> None:
            d = np.sqrt(np.maximum(0.0, total[rows, None] - 2 * (q[rows] @ x[centers[which]].T)))
            up = (total[rows, None] - np.maximum(0.0, d - radii[which]) ** 2) / 2 + slack[rows, None]
            down = (total[rows, None] - (d + radii[which]) ** 2) / 2 - slack[rows, None]
            if parent is not None:
                up, down = np.minimum(up, upper[rows, parent, None]), np.maximum(down, lower[rows, parent, None])
            upper[np.ix_(rows, which)], lower[np.ix_(rows, which)] = up, down

        bound(np.arange(len(who)), [0], None)
        for k in range(nodes):  # parents stand first: a subtree is entered for the anchors that need it
            if children[k] and len(rows := np.unique(at[wanted(np.full(len(among), k))])):
                bound(rows, children[k], k)
        leaves = np.flatnonzero(tree["leaf"])
        best_first = leaves[np.argsort(-upper[:, leaves], axis=1, kind="stable")]
        small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2.0**53
        done, step = 0, 1
        while done < len(leaves):  # best-first, in steps that double
            next_leaves = best_first[at, done : done + step]
            live = (np.take_along_axis(upper[at], next_leaves, 1) >= self.low[among, None]) & (np.take_along_axis(lower[at], next_leaves, 1) <= self.high[among, None])
            if not live.any() and not (upper[at, next_leaves[:, 0]] >= self.low[among]).any():
                break
            done, step, found = done + step, 2 * step, []
            which, slot = np.nonzero(live)
            node = next_leaves[which, slot]
            for leaf in np.unique(node):
                ws, part = which[node == leaf], slice(starts[leaf], stops[leaf])
                rows, back = np.unique(at[ws], return_inverse=True)
                scores = products(q[rows], x[part], small)[back]
                w, j = np.nonzero((scores >= self.low[among[ws], None]) & (scores <= self.high[among[ws], None]))
                found.append((among[ws[w]], scores[w, j].astype(np.int64), tree["ids"][part][j]))
            if not found:
                continue
            window, score, ids = (np.concatenate(f) for f in zip(*found))
            other = ids != self.anchors["ids"][self.own[window]]
            self.add(window[other], score[other], ids[other])


def searched(index: DataFrame, anchors: dict, own, low, high, k: int, same: bool) -> DataFrame:
    """(win, vec_id, score): the best k vectors of each window in each partition, of the anchor's label or of others."""
    shared = index.sparkSession.sparkContext.broadcast((anchors, own, low, high))

    def search(batches):
        anchors, own, low, high = shared.value
        state = Windows(anchors, own, low, high, k)
        for batch in batches:
            for i in range(batch.num_rows):
                label, dim = batch.column("label")[i].as_py(), batch.column("dim")[i].as_py()
                fits = (anchors["dims"] == dim) & ((anchors["labels"] == label) == same)
                if not len(among := np.flatnonzero(fits[own])):
                    continue
                tree = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in batch.schema.names[2:]}
                tree["x"] = tree["x"].reshape(-1, dim) if dim else np.zeros((len(tree["ids"]), 0))
                cut = {**anchors, "x": anchors["x"][:, :dim]}
                state.anchors = cut
                state.visit(tree, among)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in state.best()], ["win", "vec_id", "score"])

    found = index.mapInArrow(search, "win long, vec_id long, score long")
    by = Window.partitionBy("win").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine_block(index: DataFrame, rows: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Hard negatives of a block of anchors (vec_id, label, dim, v)."""
    spark, dim = index.sparkSession, max(r["dim"] for r in rows)
    x = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x[i, : r["dim"]] = np.floor(256.0 * np.array(r["v"], np.float64))
    anchors = {"ids": np.array([r["vec_id"] for r in rows]), "labels": np.array([r["label"] for r in rows]), "dims": np.array([r["dim"] for r in rows]), "x": x}
    every, ends = np.arange(len(rows)), np.iinfo(np.int64)
    found = searched(index, anchors, every, np.full(len(rows), ends.min), np.full(len(rows), ends.max), positives, True)
    pairs = found.orderBy("win", "rank").collect()  # `positives` an anchor
    own, score = np.array([p["win"] for p in pairs], np.int64), [p["score"] for p in pairs]
    lows = np.array([-(-low * s // 100) for s in score], np.int64)
    highs = np.array([high * s // 100 for s in score], np.int64)
    hits = searched(index, anchors, own, lows, highs, negatives, False)
    told = [(i, int(anchors["ids"][p["win"]]), p["vec_id"], p["score"]) for i, p in enumerate(pairs)]
    names = spark.createDataFrame(told, "win long, anchor_id long, positive_id long, positive_score long")
    return hits.join(F.broadcast(names), "win").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def taking_part(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, dim, v) of the rows that take part, labels moved on where the id is divisible by 7."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.size("v").alias("dim"), "v")


def cover_index(rows: DataFrame) -> DataFrame:
    """Cover trees over rows of taking_part(): those of one label near one center share partitions and trees; saved."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD))
    centers = rows.groupBy("label", "dim", salt.alias("salt")).agg(F.min_by("v", F.xxhash64("vec_id", F.lit(5))).alias("c"))
    centers = centers.groupBy("label", "dim").agg(F.flatten(F.collect_list("c")).alias("c"))  # SPREAD at most
    dealt = save(rows.join(centers, ["label", "dim"]).mapInArrow(nearest, "vec_id long, label long, dim int, v array<double>, pick int"), "dealt")
    parts = max(1, -(-dealt.count() // TREE))
    ordered = dealt.repartitionByRange(parts, "label", "dim", "pick", F.xxhash64("vec_id")).sortWithinPartitions("label", "dim", "pick")
    index = save(ordered.mapInArrow(build, TREES), "trees")
    discard(dealt)
    return index


def mine_negatives(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Anchors are the rows whose id is divisible by `every`. A score is the inner product of the whole numbers
    floor(256 x); higher scores come first, ties by smaller id. An anchor's positives are its first `positives` other
    rows of the same label; of each, the first `negatives` rows of other labels whose score lies between `low` and
    `high` hundredths of the positive's are returned.

    Vectors of a label near one of SPREAD centers share trees of up to TREE vectors. A vector gets one coordinate more
    so that all norms of a tree are equal; then a node's center and covering radius bound the inner products of its
    vectors from above and below. For each window of scores, nodes outside it are skipped, leaves are visited
    best-first while they may still hold a score that counts, and scored in whole numbers. Anchors are searched in
    blocks of ANCHORS, each block a pass over the trees; in data without clusters the bounds prune little and the
    work grows with anchors times rows.

    Rows with a null id, label or vector, or a null or non-finite component take no part; where the id is divisible
    by 7 the label becomes (label + 1) % 10. Empty vectors have score 0; vectors of different lengths do not meet.
    Rows of one id are rows of their own, but none is another's positive or negative. Scores beyond 64 bits are an error. Other columns are
    not read.
    """
    rows = save(taking_part(vectors, vec_id, embedding, label), "vectors")
    index = cover_index(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    blocks, found = max(1, -(-anchors.count() // ANCHORS)), []
    chosen = save(anchors.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "anchors") if blocks > 1 else anchors.withColumn("block", F.lit(0))
    for b in range(blocks):
        block = chosen.where(F.col("block") == b).orderBy("vec_id").collect()  # about ANCHORS rows
        if block:
            found.append(mine_block(index, block, positives, negatives, low, high))
    if not found:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, found)


def op12(spark, sf_dir: str) -> DataFrame:
    return mine_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])), 0)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
pos AS (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS n FROM p WHERE same QUALIFY n <= {POSITIVES}),
neg AS (SELECT pos.*, p.vec_id AS negative_id, p.score AS negative_score, row_number() OVER (PARTITION BY pos.ar, pos.n ORDER BY p.score DESC, p.vec_id)::INT AS rank
    FROM pos JOIN p ON p.ar = pos.ar AND NOT p.same AND {LOW} * positive_score <= 100 * p.score AND 100 * p.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}
"""
