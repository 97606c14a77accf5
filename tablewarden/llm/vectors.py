"""Exact near-duplicate vectors by cover trees and dual traversal."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

THRESHOLD = 0.93
#: Most vectors of a distributed leaf, most children of a distributed node and of one in a task, vectors of a leaf in a task.
LEAF, SPREAD, FAN, SMALL = 2048, 16, 64, 128


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # large components would overflow when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Node:
    """Members within `radius` of the center; children cover them at half the level's radius where points allow."""

    def __init__(self, x: np.ndarray, members: np.ndarray, level: float) -> None:
        self.members, self.children = members, []
        self.center = x[members[0]]
        self.radius = float(np.sqrt(((x[members] - self.center) ** 2).sum(axis=1).max()))
        if len(members) <= SMALL or self.radius < 1e-6:
            return
        own, most = x[members], min(FAN, -(-len(members) // SMALL))
        away, owner = np.full(len(members), np.inf), np.zeros(len(members), np.int64)
        for k in range(most):
            far = int(np.argmax(away)) if k else 0
            if k and away[far] <= level / 2:
                break
            d = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
            owner[d < away] = k
            away = np.minimum(away, d)
        for k in range(owner.max() + 1):
            if (part := members[owner == k]).size and part.size < members.size:
                self.children.append(Node(x, part, level / 2))


def traverse(a: Node, b: Node, xa: np.ndarray, xb: np.ndarray, threshold: float, same: bool):
    """Index pairs with cosine >= threshold; for a tree with itself each pair once."""
    reach, stack, out = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9, [(a, b)], []
    while stack:
        m, n = stack.pop()
        if np.sqrt(((m.center - n.center) ** 2).sum()) > m.radius + n.radius + reach:
            continue
        if not m.children and not n.children:
            i, j = np.nonzero(xa[m.members] @ xb[n.members].T >= threshold)
            i, j = m.members[i], n.members[j]
            if same and m is n:
                i, j = i[i < j], j[i < j]
            if len(i):
                out.append((i, j))
        elif same and m is n:
            stack += [(p, q) for k, p in enumerate(m.children) for q in m.children[k:]]
        elif m.children and (not n.children or m.radius >= n.radius):
            stack += [(p, n) for p in m.children]
        else:
            stack += [(m, q) for q in n.children]
    none = np.zeros(0, np.int64)
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (none, none)


def block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within a pair of leaves: for each class that has any, how many vectors it links to and its group's root."""
    pdf = pdf.sort_values(["side", "cls"], kind="stable")
    cls, copies, side = pdf["cls"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
    x = unit(pdf["embedding"])
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1)
    same = len(two) == 0
    if not len(one):
        return pd.DataFrame({"cls": [], "links": [], "root": []}).astype("int64")
    ta = Node(x, one, 2.0)
    tb = ta if same else Node(x, two, 2.0)
    i, j = traverse(ta, tb, x, x, THRESHOLD, same)
    links = np.zeros(len(cls), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root = np.arange(len(cls))
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    hit = links > 0
    return pd.DataFrame({"cls": cls[hit], "links": links[hit], "root": cls[root[hit]]})


def nearest(batches):
    """The child that each vector goes to: its nearest center."""
    for batch in batches:
        pick, away = np.zeros(len(batch), np.int64), np.zeros(len(batch))
        for _, at in batch.groupby("node").indices.items():
            centers = unit(list(batch["centers"].iloc[at[0]]))
            x = unit(batch["embedding"].iloc[at])
            d = np.maximum(0, 2 - 2 * (x @ centers.T))
            pick[at] = d.argmin(axis=1)
            # from the difference itself: tiny distances drown in the product
            away[at] = np.sqrt(((x - centers[pick[at]]) ** 2).sum(axis=1))
        out = batch[["node", "cls", "copies", "embedding", "piece"]].copy()
        out["pick"], out["away"] = pick, away
        yield out


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id): links by cosine >= THRESHOLD within a label, exact.

    Equal vectors of a label, and multiples by powers of two, are one class with a number of copies. Each (label, dimension) is the root of a cover tree
    whose levels are split by Spark: nodes of over LEAF classes get up to SPREAD centers, vectors go to the nearest, and
    nodes keep their measured covering radius; levels repeat until leaves are small. A node that keeps over nine tenths
    of its parent's classes (points that coincide, or nearly) is dealt into pieces by hash instead, so levels end. Pairs of nodes follow the
    levels and are dropped when their centers are farther apart than both radii and the threshold's distance. A
    task takes a pair of leaves, builds trees with halving radii in it, and traverses both. It returns a row for each
    class that has links, never the pairs. In data with no clusters at all the bounds prune little and the work
    grows with the square of a label's classes, spread over leaf pairs.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.
    """
    v = F.transform(embedding, lambda x: x.cast("double"))
    ok = F.expr(f"`{label}` is not null and `{embedding}` is not null and size(`{embedding}`) > 0 and forall(`{embedding}`, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(`{embedding}`, x -> x <> 0)")
    # -0.0 is 0.0 in sums, so that equal vectors hash equal; so do multiples by powers of two, whose quotients are exact
    most = F.array_max(F.transform(v, F.abs))
    scaled = F.transform(v, lambda x: x / F.nullif(most, F.lit(0.0)) + 0.0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(F.coalesce(ok, F.lit(False)), F.xxhash64(label, scaled)).alias("cls"), F.xxhash64(label, F.size(embedding)).alias("node"), v.alias("embedding"))
    rows = save(rows, "vectors")
    classes = save(rows.where("cls is not null").groupBy("node", "cls").agg(F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "classes")
    now = classes
    sizes = save(now.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.lit(3.0).alias("radius"), F.min_by("embedding", "cls").alias("center"), F.lit(False).alias("scatter")), "nodes")
    pairs = sizes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    while (sizes.agg(F.max("n")).first()[0] or 0) > LEAF:
        wide = F.ceil(2 * F.col("n") / LEAF).cast("int")
        big = sizes.where(F.col("n") > LEAF).select("node", F.least(F.lit(SPREAD), wide).alias("fan"), wide.alias("pieces"), "scatter", F.col("center").alias("own"), F.col("n").alias("before"))
        split = now.join(big, "node")
        piece = F.when(F.col("scatter"), F.pmod(F.xxhash64("cls", F.lit(3)), F.col("pieces"))).otherwise(0).cast("int")
        salted = split.where("not scatter").groupBy("node", F.pmod(F.xxhash64("cls", "node"), F.col("fan")).alias("salt")).agg(F.min_by("embedding", F.xxhash64("cls", F.lit(5))).alias("c"))
        centers = salted.groupBy("node").agg(F.collect_list("c").alias("centers"))  # SPREAD at most
        centers = centers.unionByName(big.where("scatter").select("node", F.array("own").alias("centers")))
        moved = split.select("node", "cls", "copies", "embedding", piece.alias("piece")).join(centers, "node").mapInPandas(nearest, "node long, cls long, copies long, embedding array<double>, piece int, pick long, away double")
        moved = save(moved.withColumn("child", F.xxhash64("node", "pick", "piece")), "moved")
        made = moved.groupBy("node", "child").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.first("pick").alias("pick"))
        made = made.join(centers, "node").join(big.select("node", "before"), "node")
        made = made.select("node", "child", "n", "radius", F.element_at("centers", (F.col("pick") + 1).cast("int")).alias("center"), (F.col("n") * 10 > F.col("before") * 9).alias("scatter"))
        kept = sizes.where(F.col("n") <= LEAF).select("node", F.col("node").alias("child"), "n", "radius", "center", "scatter")
        level = save(made.unionByName(kept), "level")
        x = level.select(F.col("node").alias("a"), F.col("child").alias("ca"), F.col("radius").alias("ra"), F.col("center").alias("xa"))
        y = level.select(F.col("node").alias("b"), F.col("child").alias("cb"), F.col("radius").alias("rb"), F.col("center").alias("xb"))
        size = lambda z: f"sqrt(aggregate({z}, 0D, (s, v) -> s + v * v))"
        cosine = F.expr(f"aggregate(zip_with(xa, xb, (p, q) -> p * q), 0D, (s, v) -> s + v) / ({size('xa')} * {size('xb')})")
        reach = F.col("ra") + F.col("rb") + float(np.sqrt(2 - 2 * THRESHOLD)) + 1e-6
        both = pairs.join(x, "a").join(y, "b").where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
        pairs = save(both.where((F.col("ca") == F.col("cb")) | (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine)) <= reach)).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "pairs")
        now = save(moved.select(F.col("child").alias("node"), "cls", "copies", "embedding").unionByName(now.join(big, "node", "left_anti")), "now")
        sizes = save(level.select(F.col("child").alias("node"), "n", "radius", "center", "scatter"), "nodes")
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side"))))).alias("s"))
    members = now.join(sides.select("a", "b", "s.*"), "node").select("a", "b", "side", "cls", "copies", "embedding")
    found = save(members.groupBy("a", "b").applyInPandas(lambda pdf: block(pdf), "cls long, links long, root long"), "links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), vectors.sparkSession)
    per = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    per = per.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(counts, "cls", "left")
    best = per.groupBy("component").agg(F.min("least").alias("component_id"))
    per = save(per.join(best, "component").select("cls", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    return rows.join(per, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))


def op10(spark, sf_dir: str) -> DataFrame:
    found = link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
