"""Findings from column lineage: leakage, classified sources, proxies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text, urn
from . import walk


def derived_features(linked: DataFrame, refs: DataFrame, matches: DataFrame, finding_type: str) -> DataFrame:
    """A finding for each model and feature whose source column has a marked ancestor (or is one).

    linked: linked_features(); matches: marked_ancestors() of their distinct sources. The quoted path is the best match.
    """
    best = walk.best_match(matches).withColumnRenamed("root", "source")
    rows = linked.join(best, "source").join(refs.select("model_urn", F.col("name").alias("model_name"), "is_live"), "model_urn")
    names = F.transform("path", urn.field_path)
    a, b = urn.field_path("source"), urn.field_path("ancestor")
    title = F.concat(F.lit("Target leakage: "), a, F.lit(" derives from label "), b) if finding_type == "target_leakage" else F.concat(F.lit("Sensitive source: "), a, F.lit(" derives from "), urn.marker_name("marker_urn"), F.lit(" column "), b)
    return rows.select(
        F.lit(finding_type).alias("finding_type"), "model_urn", "model_name", "is_live", "feature_urn", "feature_name", F.col("source").alias("resource_urn"), "ancestor", "marker_urn",
        "path", "paths", F.size("other_paths").alias("n_other_paths"), text.path_text(names).alias("path_text"), title.alias("title"), rules.severity(F.lit(finding_type), F.col("is_live")).alias("severity"),
    )


def proxy_candidates(linked: DataFrame, refs: DataFrame, lineage: DataFrame, protected: DataFrame, classified: DataFrame, hops: int) -> DataFrame:
    """One candidate for each model, source column and protected column that share an ancestor.

    Sources that descend from a classified column (classified: (root)) are findings of their own and left out. The
    walk down starts at ancestors of sources only and keeps protected columns only. Nearest ancestor by both
    distances, then its URN, then feature order.
    """
    up = lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst"))
    sources = linked.select(F.col("source").alias("root"), F.col("source").alias("node")).distinct().join(classified.select("root").distinct(), "root", "left_anti")
    above = walk.reach(sources, up, hops).where("hops > 0").select("root", F.col("node").alias("ancestor"), F.col("hops").alias("up_hops"))
    # from the protected columns up: the same pairs as down from the ancestors, with far fewer roots
    marked = protected.select(F.col("column_urn").alias("root"), F.col("column_urn").alias("node"))
    below = walk.reach(marked, up, hops).where("hops > 0").select(F.col("root").alias("protected"), F.col("node").alias("ancestor"), F.col("hops").alias("down_hops"))
    forks = above.join(below, "ancestor").where("protected <> root and protected <> ancestor")
    near = Window.partitionBy("root", "protected").orderBy(F.col("up_hops") + F.col("down_hops"), "ancestor")
    forks = forks.withColumn("rn", F.row_number().over(near)).where("rn = 1").drop("rn").join(protected.withColumnRenamed("column_urn", "protected"), "protected")
    first = Window.partitionBy("model_urn", "source", "protected").orderBy("pos", "feature_urn")
    rows = linked.join(forks, linked["source"] == forks["root"]).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    rows = rows.join(refs.select("model_urn", F.col("name").alias("model_name"), "is_live"), "model_urn")
    title = F.concat(F.lit("Proxy candidate: "), urn.field_path("source"), F.lit(" shares "), urn.field_path("ancestor"), F.lit(" with "), urn.marker_name("marker_urn"), F.lit(" column "), urn.field_path("protected"))
    return rows.select(F.lit("proxy_candidate").alias("finding_type"), "model_urn", "model_name", "is_live", "feature_urn", "feature_name", F.col("source").alias("resource_urn"), "protected", "ancestor", "marker_urn", "up_hops", "down_hops", title.alias("title"), F.lit("medium").alias("severity"))


def shared_protected(lineage: DataFrame, protected: DataFrame, classified: DataFrame, hops: int, deep: int) -> DataFrame:
    """(source, protected): for every column with a proxy candidate, with how many protected columns it shares an ancestor.

    classified: (node, hops), columns up to `deep` below a classified one, which are left out as proxy_candidates() does. All
    that lies `hops` below an ancestor that is near enough to a classified column is left out too, so nothing is walked there.
    """
    up = lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    marked = protected.select(F.col("column_urn").alias("root"), F.col("column_urn").alias("node"))
    above = walk.reach(marked, up, hops).where("hops > 0").select(F.col("root").alias("protected"), F.col("node").alias("ancestor"))
    near = classified.where(F.col("hops") <= deep - hops).select(F.col("node").alias("ancestor"))
    above = walk.cut(above.join(near, "ancestor", "left_anti"))
    under = walk.reach(above.select(F.col("ancestor").alias("root"), F.col("ancestor").alias("node")), down, hops).where("hops > 0").select(F.col("root").alias("ancestor"), F.col("node").alias("source"))
    clear = under.join(classified.select(F.col("node").alias("source")), "source", "left_anti")
    pairs = clear.join(above, "ancestor").where("protected <> source").select("source", "protected").distinct()
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("protected"))
