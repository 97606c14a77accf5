"""Models, their deployments, owners, inputs and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urn


def model_refs(models: DataFrame, model_deployments: DataFrame, deployments: DataFrame, owners: DataFrame) -> DataFrame:
    """(model_urn, name, n_deployments, n_live, is_live, has_owner): a deployment is live only when it says IN_SERVICE."""
    per = model_deployments.select("model_urn", "deployment_urn").distinct().join(deployments, "deployment_urn", "left")
    counts = per.groupBy("model_urn").agg(F.count_distinct("deployment_urn").alias("n_deployments"), F.count_distinct(F.when(F.col("status") == "IN_SERVICE", F.col("deployment_urn"))).alias("n_live"))
    owned = owners.select(F.col("entity_urn").alias("model_urn")).distinct().withColumn("has_owner", F.lit(True))
    out = models.join(counts, "model_urn", "left").join(owned, "model_urn", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("model_urn", urn.model_name("name", "model_urn").alias("name"), zero("n_deployments"), zero("n_live"), (F.coalesce("n_live", F.lit(0)) > 0).alias("is_live"), F.coalesce("has_owner", F.lit(False)).alias("has_owner"))


def source_columns(features: DataFrame) -> DataFrame:
    """(feature_urn, feature_name, source): features whose source column can be read."""
    return features.where(urn.field_parent("source_column_urn").isNotNull()).select("feature_urn", "feature_name", F.col("source_column_urn").alias("source"))


def linked_features(model_features: DataFrame, features: DataFrame) -> DataFrame:
    """(model_urn, feature_urn, pos, source): features whose source column can be read."""
    return model_features.join(source_columns(features), "feature_urn").select("model_urn", "feature_urn", "feature_name", "pos", "source")


def model_inputs(model_runs: DataFrame, run_inputs: DataFrame) -> DataFrame:
    """(model_urn, dataset_urn): distinct inputs of a model's runs."""
    return model_runs.select("model_urn", "run_urn").join(run_inputs.select("run_urn", "dataset_urn"), "run_urn").select("model_urn", "dataset_urn").distinct()


def column_markers(marks: DataFrame, *markers: str) -> DataFrame:
    """(column_urn, marker_urn): one marker of the set for each column.

    Marks made in the interface come before those of the source, terms before tags, then the first in order.
    """
    order = F.struct(F.col("origin") != "editable", F.col("kind") != "term", "pos", "marker_urn")
    return marks.where(F.col("marker_urn").isin(*markers)).groupBy("column_urn").agg(F.min_by("marker_urn", order).alias("marker_urn"))


def next_markers(marks: DataFrame, *markers: str) -> DataFrame:
    """(column_urn, marker_urn): the marker of the set that a column has once its first one is taken away everywhere."""
    first = column_markers(marks, *markers)
    return column_markers(marks.join(first, ["column_urn", "marker_urn"], "left_anti"), *markers)


def lineage_edges(table_lineage: DataFrame, features: DataFrame, model_features: DataFrame) -> DataFrame:
    """(src, dst): dataset to dataset, dataset to feature, feature to model."""
    parts = [
        table_lineage.select(F.col("upstream_urn").alias("src"), F.col("downstream_urn").alias("dst")),
        features.where("source_dataset_urn is not null").select(F.col("source_dataset_urn").alias("src"), F.col("feature_urn").alias("dst")),
        model_features.select(F.col("feature_urn").alias("src"), F.col("model_urn").alias("dst")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
