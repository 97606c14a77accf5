"""Bounded walks over lineage edges, for all starting nodes at once.

Edges are (src, dst) and walked from src to dst; reverse them to walk upstream. The driver runs one join a hop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut

#: Rows that are broadcast, once they are counted.
FEW = 100_000


def reach(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(root, node, hops): every node within `hops` of a start (root, node), by least hops; starts have 0.

    Each round keeps only nodes that a root has not seen, so cycles end and a node is expanded once a root.
    """
    seen = cut(starts.select("root", "node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, hops + 1):
        found = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = cut(found.join(seen, ["root", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def chains(starts: DataFrame, edges: DataFrame, hops: int, stops: DataFrame | None = None, useful: DataFrame | None = None) -> DataFrame:
    """(root, path): every path from a start that visits no node twice, of up to `hops` edges, the start alone included.

    A path ends at the first node of `stops` (node). With `useful` (node, left), a path goes on only to nodes that can
    still reach a stop within the hops that are left.
    """
    halt = stops.select(F.col("node"), F.lit(True).alias("halt")) if stops is not None else None

    def marked(df: DataFrame) -> DataFrame:
        return df.join(halt, "node", "left") if halt is not None else df.withColumn("halt", F.lit(None).cast("boolean"))

    front = cut(marked(starts.select("root", "node").distinct()).withColumn("path", F.array("node")))
    rounds = [front]
    for hop in range(1, hops + 1):
        step = front.where("halt is null").drop("halt").join(edges, F.col("node") == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        if useful is not None:
            step = step.join(useful.where(F.col("left") <= hops - hop).select("node"), "node", "left_semi")
        front = cut(marked(step.distinct()))
        if front.isEmpty():
            break
        rounds.append(front)
    return reduce(DataFrame.unionByName, rounds).select("root", "path", "node", "halt")


def marked_ancestors(columns: DataFrame, lineage: DataFrame, markers: DataFrame, hops: int) -> DataFrame:
    """(root, path, ancestor, marker_urn): for each path upstream of a column, its first marked column within `hops`.

    columns: (column_urn); markers: (column_urn, marker_urn). A start that is marked itself is its only match, with a
    path of one. Nodes that reach a mark are found first, from the marks down, so no other path is built.
    """
    up = lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    stops = markers.select(F.col("column_urn").alias("node"))
    # walked as one root, so a node counts once whatever the number of marks below which it lies
    near = reach(stops.select(F.lit("").alias("root"), "node"), down, hops).select("node", F.col("hops").alias("left"))
    useful = cut(near)
    starts = columns.select(F.col("column_urn").alias("root"), F.col("column_urn").alias("node")).join(useful.select("node"), "node", "left_semi")
    found = chains(starts, up, hops, stops, useful).where("halt")
    return found.join(markers, found["node"] == markers["column_urn"]).select("root", "path", F.col("node").alias("ancestor"), "marker_urn")


def below(marks: dict[str, DataFrame], lineage: DataFrame, hops: int) -> DataFrame:
    """(root, node, hops): columns that are marked or lie within `hops` below a marked one; root names the marks (column_urn).

    These are the columns for which marked_ancestors() has a match, found without their paths.
    """
    down = lineage.select(F.col("upstream_column_urn").alias("src"), F.col("downstream_column_urn").alias("dst"))
    starts = [rows.select(F.lit(name).alias("root"), F.col("column_urn").alias("node")) for name, rows in marks.items()]
    return reach(reduce(DataFrame.unionByName, starts), down, hops)


def first_marked(columns: DataFrame, lineage: DataFrame, markers: DataFrame, near: DataFrame, hops: int) -> DataFrame:
    """(root, node, marker_urn): the marked columns at the ends of marked_ancestors(), once each, without the paths.

    near: (node, hops), columns within `hops` below a marked one. A walk ends at marked columns, and goes on only to columns
    that can still reach one within the hops that are left.
    """
    up = lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst"))
    # an edge that leads to no mark, or leaves a marked column, is on no walk
    useful = cut(near.select("node", F.col("hops").alias("left")))
    open_ends = useful.where("left > 0").select(F.col("node").alias("src"))
    edges = cut(up.join(open_ends, "src", "left_semi").join(useful.select(F.col("node").alias("dst"), "left"), "dst").select("src", "dst", "left").distinct())
    seen = cut(useful.join(columns.select(F.col("column_urn").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("root"), "node"))
    front, rounds = seen, [seen]
    for hop in range(1, hops + 1):
        found = front.join(edges.where(F.col("left") <= hops - hop), front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = cut(found.join(reduce(DataFrame.unionByName, rounds), ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        rounds.append(front)
    ends = reduce(DataFrame.unionByName, rounds)
    return ends.join(markers.select(F.col("column_urn").alias("node"), "marker_urn"), "node").select("root", "node", "marker_urn")


def bounded_reach(starts: DataFrame, edges: DataFrame, hops: int, cap: int) -> DataFrame:
    """(root, node, hops): as reach() without the starts, but a root stops at `cap` nodes, nearest first, then by name.

    A root has at most `cap` nodes at any time and is dropped from the frontier once it has them, so nothing beyond is
    built. Of a node's edges the first 2 cap + 1 by name are enough: fewer than `cap` of them can be known already, and
    no more than `cap` are wanted.
    """
    order = Window.partitionBy("src").orderBy("dst")
    few = cut(edges.select("src", "dst").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * cap + 1).drop("nth"))
    seen = cut(starts.select("root", "node").distinct().withColumn("hops", F.lit(0)))
    front = seen.select("root", "node", F.lit(0).cast("long").alias("held"))
    level = Window.partitionBy("root")
    rounds = [seen]
    for hop in range(1, hops + 1):
        found = front.join(few, front["node"] == few["src"]).select("root", F.col("dst").alias("node"), "held").distinct()
        new = found.join(reduce(DataFrame.unionByName, rounds), ["root", "node"], "left_anti")
        new = new.withColumn("nth", F.row_number().over(level.orderBy("node"))).where(F.col("held") + F.col("nth") <= cap)
        new = cut(new.withColumn("held", F.col("held") + F.count(F.lit(1)).over(level)).drop("nth").withColumn("hops", F.lit(hop)))
        if new.isEmpty():
            break
        rounds.append(new.drop("held"))
        front = new.where(F.col("held") < cap).select("root", "node", "held")
    return reduce(DataFrame.unionByName, rounds).where("hops > 0")


def walk_limits(columns: DataFrame, lineage: DataFrame, hops: int, cap: int) -> DataFrame:
    """(root, cone, truncated, hop_capped): size of what lies upstream, up to `cap`, and whether a limit may hide matches.

    A walk that the cap stops is hop capped as far as it came.
    """
    up = lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst"))
    seen = bounded_reach(columns.select(F.col("column_urn").alias("root"), F.col("column_urn").alias("node")), up, hops + 1, cap)
    cone = seen.groupBy("root").agg(F.count(F.lit(1)).alias("cone"), F.max("hops").alias("deepest"))
    return cone.select("root", "cone", (F.col("cone") >= cap).alias("truncated"), (F.col("deepest") > hops).alias("hop_capped"))


def limited(columns: DataFrame, lineage: DataFrame, hops: int, cap: int) -> DataFrame:
    """(root, truncated, hop_capped): as walk_limits(), of the columns that a limit stops and no others.

    Ways up are counted from those of the neighbours, a hop at a time and up to `cap`. A column with fewer than `cap` in
    all and none of hops + 1 edges meets no limit and is not walked; nor are edges above no other column.
    """
    up = lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst"))
    rounds, ways = [], up.groupBy("src").agg(F.count(F.lit(1)).alias("ways"))
    for hop in range(1, hops + 2):
        front = cut(ways.select("src", F.least("ways", F.lit(cap)).alias("ways"), F.lit(hop).alias("hop")))
        rounds.append(front)
        if front.isEmpty():
            break
        ways = up.join(front.select(F.col("src").alias("dst"), "ways"), "dst").groupBy("src").agg(F.sum("ways").alias("ways"))
    risky = reduce(DataFrame.unionByName, rounds).groupBy("src").agg(F.sum("ways").alias("ways"), F.max("hop").alias("hop")).where((F.col("ways") >= cap) | (F.col("hop") > hops))
    risky = cut(risky.select(F.col("src").alias("column_urn")))
    asked = cut(columns.distinct().join(risky, "column_urn", "left_semi") if risky.count() > FEW else columns.join(F.broadcast(risky), "column_urn", "left_semi").distinct())
    seen = reach(asked.select(F.lit("").alias("root"), F.col("column_urn").alias("node")), up, hops)
    near = lineage.join(seen.select(F.col("node").alias("downstream_column_urn")), "downstream_column_urn", "left_semi")
    return walk_limits(asked, near, hops, cap).where("truncated or hop_capped").select("root", "truncated", "hop_capped")


def best_match(matches: DataFrame) -> DataFrame:
    """The quoted match of each root: shortest path, then ancestor, then path; with the number of matches and other paths."""
    order = F.struct(F.size("path"), "ancestor", F.array_join("path", "|"))
    best = F.min_by(F.struct("path", "ancestor", "marker_urn"), order).alias("best")
    grouped = matches.groupBy("root").agg(best, F.count(F.lit(1)).alias("n_matches"), F.sort_array(F.collect_set("path")).alias("paths"))
    return grouped.select("root", "best.*", "n_matches", F.filter("paths", lambda p: p != F.col("best.path")).alias("other_paths"), "paths")


def capped(starts: DataFrame, edges: DataFrame, hops: int, cap: int) -> DataFrame:
    """(root, node, hops, rank, truncated): at most `cap` nodes of each root, nearest first, and whether there may be more."""
    by = Window.partitionBy("root")
    rows = bounded_reach(starts, edges, hops, cap)
    return rows.withColumn("rank", F.row_number().over(by.orderBy("hops", "node"))).withColumn("truncated", F.count(F.lit(1)).over(by) >= cap)
