"""Findings counted for each column and model, without a row for each of them: what gaps, scores and facts need to know."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, walk


def of_columns(below: DataFrame, shared: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, leaks, exposed, protected, truncated, hop_capped): columns of which there is anything to say, once each.

    below: walk.below() of `label` and `class`; shared: columns.shared_protected(); limits: walk.limited().
    """
    said = {"leaks": F.lit(False), "exposed": F.lit(False), "protected": F.lit(0).cast("long"), "truncated": F.lit(False), "hop_capped": F.lit(False)}

    def rows(df: DataFrame, column: str, **known) -> DataFrame:
        return df.select(F.col(column).alias("source"), *[c.alias(n) for n, c in (said | known).items()])

    every = rows(below, "node", leaks=F.col("root") == "label", exposed=F.col("root") == "class")
    every = every.unionByName(rows(shared, "source", protected=F.col("protected"))).unionByName(rows(limits, "root", truncated=F.col("truncated"), hop_capped=F.col("hop_capped")))
    return every.groupBy("source").agg(*[F.max(n).alias(n) for n in said])


def of_features(model_features: DataFrame, features: DataFrame, facts: DataFrame) -> DataFrame:
    """(model_urn, features, with_source, n_features, n_sources, leaks, exposures, truncated, hop_capped) of each model with features.

    facts: of_columns(). features and with_source count rows, n_features and n_sources distinct features; leaks and exposures are
    findings, one for each row with a source. Rows meet at their feature, so a distinct count needs no further shuffle.
    """
    known = models.source_columns(features).select("feature_urn", "source").join(facts.select("source", "leaks", "exposed", "truncated", "hop_capped"), "source", "left")
    asked = model_features.select("model_urn", "feature_urn").repartition("feature_urn").groupBy("feature_urn", "model_urn").agg(F.count(F.lit(1)).alias("n"))
    each = asked.join(known, "feature_urn", "left").groupBy("feature_urn", "model_urn", "n")
    each = each.agg(F.count("source").alias("k"), F.count_if("leaks").alias("leaks"), F.count_if("exposed").alias("exposed"), F.max("truncated").alias("truncated"), F.max("hop_capped").alias("hop_capped"))
    return each.groupBy("model_urn").agg(
        F.sum("n").alias("features"), F.sum(F.col("n") * F.col("k")).alias("with_source"), F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("k") > 0).alias("n_sources"),
        F.sum(F.col("n") * F.col("leaks")).alias("leaks"), F.sum(F.col("n") * F.col("exposed")).alias("exposures"), F.max("truncated").alias("truncated"), F.max("hop_capped").alias("hop_capped"),
    )


def proxies(model_features: DataFrame, features: DataFrame, shared: DataFrame) -> DataFrame:
    """(model_urn, n): proxy candidates of a model, one for each of its source columns and a protected column."""
    some = models.source_columns(features).select("feature_urn", "source").join(shared, "source")
    rows = model_features.select("model_urn", "feature_urn").join(some, "feature_urn").select("model_urn", "source", "protected").distinct()
    return rows.groupBy("model_urn").agg(F.sum("protected").alias("n"))


def drifts(model_runs: DataFrame, run_inputs: DataFrame, snapshots: DataFrame, training: DataFrame, current: DataFrame) -> DataFrame:
    """(model_urn, n): inputs of runs whose schema differs from the current one; as tables.schema_drift() finds them.

    A schema is the sorted set of its fields with a known type, a row for each table and snapshot.
    """
    schema = F.array_sort(F.collect_set(F.when(F.col("native_type").isNotNull(), F.struct("field_path", "native_type"))))
    now = current.groupBy("dataset_urn").agg(schema.alias("now"))
    trained = training.groupBy("run_urn", "dataset_urn").agg(schema.alias("trained"))
    both = run_inputs.select("run_urn", "dataset_urn").distinct().join(snapshots.select("run_urn", "dataset_urn").distinct(), ["run_urn", "dataset_urn"])
    rows = both.join(trained, ["run_urn", "dataset_urn"], "left").join(now, "dataset_urn")
    same = F.when(F.col("trained").isNull(), F.size("now") == 0).otherwise(F.col("trained") == F.col("now"))
    changed = rows.where(~same).select("run_urn").join(model_runs.select("model_urn", "run_urn").distinct(), "run_urn")
    return changed.groupBy("model_urn").agg(F.count(F.lit(1)).alias("n"))


def freshness(stale: DataFrame, table_lineage: DataFrame, features: DataFrame, model_features: DataFrame, hops: int) -> DataFrame:
    """(model_urn, n, lag_hours): how many stale tables reach a model within `hops`, and the greatest lag among them.

    A table reaches a model by its features: two hops, after those from table to table. Stale tables travel as numbers.
    """
    named = walk.cut(stale.select("dataset_urn", "lag_hours", F.monotonically_increasing_id().alias("root")))
    edges = table_lineage.select(F.col("upstream_urn").alias("src"), F.col("downstream_urn").alias("dst"))
    near = walk.reach(named.select("root", F.col("dataset_urn").alias("node")), edges, hops - 2).select("root", F.col("node").alias("source_dataset_urn"))
    used = features.where("source_dataset_urn is not null").select("feature_urn", "source_dataset_urn").join(model_features.select("model_urn", "feature_urn"), "feature_urn")
    pairs = used.select("model_urn", "source_dataset_urn").join(near, "source_dataset_urn").select("model_urn", "root").distinct()
    return pairs.join(named.select("root", "lag_hours"), "root").groupBy("model_urn").agg(F.count(F.lit(1)).alias("n"), F.max("lag_hours").alias("lag_hours"))


def found(parts: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """(model_urn, finding_type, n) of counts (model_urn, n) by finding type, for models of `known` (model_urn)."""
    rows = [p.where("n > 0").select("model_urn", F.lit(kind).alias("finding_type"), "n") for kind, p in parts.items()]
    return reduce(DataFrame.unionByName, rows).join(known.select("model_urn"), "model_urn")
