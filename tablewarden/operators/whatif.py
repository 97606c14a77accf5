"""What would clear a finding: walks that leave out an edge, a feature or a mark, each scenario by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import walk
from .steps import cut

SCENARIO = ["finding_type", "root", "remedy", "target"]


def edge_text(path: str):
    return F.concat(F.get(path, F.lit(0)), F.lit("<-"), F.get(path, F.lit(1)))


def edge_scenarios(matches: DataFrame) -> DataFrame:
    """(finding_type, root, remedy, target, src, dst): edges that a scenario leaves out.

    cut_edge leaves out the first edge of one path, cut_all the first edges of all paths. A root that is marked itself
    has no edge whose loss would help, so it has neither.
    """
    own = matches.where(F.size("path") < 2).select("finding_type", "root").distinct()
    first = matches.join(own, ["finding_type", "root"], "left_anti").select("finding_type", "root", edge_text("path").alias("target"), F.get("path", F.lit(0)).alias("src"), F.get("path", F.lit(1)).alias("dst")).distinct()
    one = first.select("finding_type", "root", F.lit("cut_edge").alias("remedy"), "target", "src", "dst")
    return one.unionByName(first.select("finding_type", "root", F.lit("cut_all").alias("remedy"), F.lit("*").alias("target"), "src", "dst"))


def mark_scenarios(matches: DataFrame) -> DataFrame:
    """(finding_type, root, remedy, target): target is the marked column whose quoted mark is taken away."""
    return matches.select("finding_type", "root", F.lit("remove_mark").alias("remedy"), F.col("ancestor").alias("target")).distinct()


def matches_left(scenarios: DataFrame, edges_out: DataFrame, lineage: DataFrame, marks: DataFrame, next_marks: DataFrame, hops: int) -> DataFrame:
    """(finding_type, root, remedy, target, paths_left): marked ancestors found again under each scenario.

    One walk for all scenarios, keyed by scenario and root. It does not take the edges that its scenario leaves out.
    In a remove_mark scenario the target has its next mark, or none, and the walk goes on past it to other marks, which
    the walk of the finding never saw. marks and next_marks: (finding_type, column_urn). Only nodes that can still reach
    a mark are entered, as in marked_ancestors(): a scenario takes edges and marks away and adds none.
    """
    up = cut(lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst")).distinct())
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = walk.reach(marks.select(F.col("finding_type").alias("root"), F.col("column_urn").alias("node")), down, hops)
    useful = cut(near.select(F.col("root").alias("finding_type"), "node", F.col("hops").alias("left")))
    first = marks.select("finding_type", F.col("column_urn").alias("node"), F.lit(True).alias("halt"))
    second = next_marks.select("finding_type", F.col("column_urn").alias("node"), F.lit(True).alias("after"))

    def marked(rows: DataFrame) -> DataFrame:
        rows = rows.join(first, ["finding_type", "node"], "left").join(second, ["finding_type", "node"], "left")
        lifted = (F.col("remedy") == "remove_mark") & (F.col("target") == F.col("node"))
        return rows.withColumn("halt", F.when(lifted, F.col("after")).otherwise(F.col("halt"))).drop("after")

    front = cut(marked(scenarios.select(*SCENARIO, F.col("root").alias("node"), F.array("root").alias("path"))))
    found = [front.where("halt")]
    for hop in range(1, hops + 1):
        step = front.where("halt is null").drop("halt").join(up, F.col("node") == up["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.join(edges_out, [*SCENARIO, "src", "dst"], "left_anti")
        step = step.select(*SCENARIO, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(useful.where(F.col("left") <= hops - hop).select("finding_type", "node"), ["finding_type", "node"], "left_semi")
        front = cut(marked(step))
        if front.isEmpty():
            break
        found.append(front.where("halt"))
    return reduce(DataFrame.unionByName, found).groupBy(*SCENARIO).agg(F.count(F.lit(1)).alias("paths_left"))


def column_remedies(linked: DataFrame, matches: DataFrame, lineage: DataFrame, marks: DataFrame, next_marks: DataFrame, hops: int) -> DataFrame:
    """(finding_type, model_urn, feature_urn, remedy, target, paths, paths_left, cleared) of findings of column lineage.

    Each remedy is tried alone: cut_edge, cut_all and remove_mark walk again (matches_left()); drop_feature takes the
    feature from its model, which helps unless another feature of the model has the same source column. A finding
    is cleared when no path to a mark is left.
    """
    edges_out = cut(edge_scenarios(matches))
    tried = edges_out.select(*SCENARIO).distinct().unionByName(mark_scenarios(matches))
    left = matches_left(tried, edges_out, lineage, marks, next_marks, hops)
    paths = matches.groupBy("finding_type", "root").agg(F.count(F.lit(1)).alias("paths"))
    walked = tried.join(left, SCENARIO, "left").na.fill(0, ["paths_left"]).join(paths, ["finding_type", "root"])
    features = linked.select("model_urn", "feature_urn", F.col("source").alias("root"))
    rows = features.join(walked, "root").select("finding_type", "model_urn", "feature_urn", "remedy", "target", "paths", "paths_left")
    shared = features.groupBy("model_urn", "root").agg((F.count_distinct("feature_urn") > 1).alias("shared"))
    dropped = features.join(shared, ["model_urn", "root"]).join(paths, "root")
    dropped = dropped.select("finding_type", "model_urn", "feature_urn", F.lit("drop_feature").alias("remedy"), F.col("feature_urn").alias("target"), "paths", F.when(F.col("shared"), F.col("paths")).otherwise(0).alias("paths_left"))
    return rows.unionByName(dropped).withColumn("cleared", F.col("paths_left") == 0)


def proxy_remedies(linked: DataFrame, proxies: DataFrame, next_protected: DataFrame) -> DataFrame:
    """The same columns for proxy candidates, whose path is the fork to one protected column.

    remove_mark takes the mark that makes the column protected; another protected mark of that column keeps the
    candidate. drop_feature as for the other findings.
    """
    rows = proxies.select("finding_type", "model_urn", "feature_urn", F.col("resource_urn").alias("source"), "protected")
    kept = next_protected.select(F.col("column_urn").alias("protected"), F.lit(1).alias("again"))
    unmarked = rows.join(kept, "protected", "left").select("finding_type", "model_urn", "feature_urn", F.lit("remove_mark").alias("remedy"), F.col("protected").alias("target"), F.coalesce("again", F.lit(0)).cast("long").alias("paths_left"))
    others = linked.groupBy("model_urn", "source").agg((F.count_distinct("feature_urn") - 1).alias("others"))
    dropped = rows.join(others, ["model_urn", "source"]).groupBy("finding_type", "model_urn", "feature_urn", "others").agg(F.count(F.lit(1)).alias("n"))
    dropped = dropped.select("finding_type", "model_urn", "feature_urn", F.lit("drop_feature").alias("remedy"), F.col("feature_urn").alias("target"), F.col("n").alias("paths"), F.when(F.col("others") > 0, F.col("n")).otherwise(0).alias("paths_left"))
    return unmarked.withColumn("paths", F.lit(1).cast("long")).unionByName(dropped).withColumn("cleared", F.col("paths_left") == 0)
