"""Findings from tables: staleness, drift, deprecation, and what a table reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text, urn
from . import walk


def downstream_reach(roots: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(root, node, kind, hops): datasets, features and models that a table reaches, each once at its least hops."""
    starts = roots.select(F.col("dataset_urn").alias("root"), F.col("dataset_urn").alias("node"))
    return walk.reach(starts, edges, hops).where("hops > 0").withColumn("kind", urn.entity_type("node"))


def upstream_datasets(roots: DataFrame, table_lineage: DataFrame, hops: int) -> DataFrame:
    """(root, node, hops): tables upstream of each table (dataset_urn)."""
    up = table_lineage.select(F.col("downstream_urn").alias("src"), F.col("upstream_urn").alias("dst"))
    starts = roots.select(F.col("dataset_urn").alias("root"), F.col("dataset_urn").alias("node"))
    return walk.reach(starts, up, hops).where("hops > 0")


def stale_tables(latest: DataFrame, now_ms: int, sla_hours: float) -> DataFrame:
    return latest.where(rules.is_stale("last_updated_ms", now_ms, sla_hours)).select("dataset_urn", "last_updated_ms", rules.lag_hours("last_updated_ms", now_ms).alias("lag_hours"))


def radius_models(reached: DataFrame, refs: DataFrame, model_features: DataFrame) -> DataFrame:
    """(root, model_urn, hops, severity, features_at_risk, ...): models that stale tables reach.

    Features at risk are the model's own features among those that the table reaches.
    """
    hit = reached.where("kind = 'mlFeature'").select("root", F.col("node").alias("feature_urn"))
    risk = hit.join(model_features.select("model_urn", "feature_urn"), "feature_urn").groupBy("root", "model_urn").agg(F.count_distinct("feature_urn").alias("features_at_risk"))
    rows = reached.where("kind = 'mlModel'").select("root", F.col("node").alias("model_urn"), "hops").join(refs, "model_urn").join(risk, ["root", "model_urn"], "left")
    severity = rules.radius_severity(F.col("is_live"), F.col("n_deployments") > 0)
    return rows.withColumn("severity", severity).withColumn("severity_rank", rules.severity_rank("severity")).withColumn("features_at_risk", F.coalesce("features_at_risk", F.lit(0)))


def models_worst_first() -> list:
    """Sort keys: severity, live deployments, features at risk, owned, URN."""
    return [F.col("severity_rank"), F.desc("n_live"), F.desc("features_at_risk"), F.col("has_owner"), F.col("model_urn")]


def blast_radius(stale: DataFrame, reached: DataFrame, radius: DataFrame, sla_hours: float) -> DataFrame:
    """A finding for each stale table: what it reaches, its models worst first, and the worst severity (medium when none)."""
    kinds = reached.groupBy("root").agg(F.count_if(F.col("kind") == "dataset").alias("n_datasets"), F.count_if(F.col("kind") == "mlFeature").alias("n_features"))
    key = F.struct("severity_rank", (-F.col("n_live")).alias("l"), (-F.col("features_at_risk")).alias("f"), "has_owner", "model_urn")
    models = radius.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["model_urn"]).alias("models"), F.min("severity_rank").alias("worst"), F.count_if("is_live").alias("n_live_models"))
    rows = stale.withColumnRenamed("dataset_urn", "root").join(kinds, "root", "left").join(models, "root", "left")
    severity = F.element_at(F.array(*[F.lit(s) for s in rules.SEVERITIES]), F.coalesce("worst", F.lit(2)) + 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.lit("upstream_freshness").alias("finding_type"), F.col("root").alias("resource_urn"), "last_updated_ms", "lag_hours", F.lit(sla_hours).alias("sla_hours"), zero("n_datasets"), zero("n_features"), F.coalesce(F.size("models"), F.lit(0)).alias("n_models"), zero("n_live_models"), F.coalesce("models", F.array().cast("array<string>")).alias("models"), severity.alias("severity"), F.concat(F.lit("Stale upstream data in "), urn.dataset_name("root")).alias("title"))


def schema_changes(model_runs: DataFrame, run_inputs: DataFrame, snapshots: DataFrame, training: DataFrame, current: DataFrame) -> DataFrame:
    """(model_urn, run_urn, dataset_urn, field_path, trained, now, kind): differences of run inputs that have a snapshot
    and a current schema. An empty snapshot counts, so every current field is then new."""
    both = run_inputs.select("run_urn", "dataset_urn").distinct().join(snapshots.select("run_urn", "dataset_urn").distinct(), ["run_urn", "dataset_urn"]).join(current.select("dataset_urn").distinct(), "dataset_urn")
    old = both.join(training.select("run_urn", "dataset_urn", "field_path", F.col("native_type").alias("trained")), ["run_urn", "dataset_urn"])
    new = both.join(current.select("dataset_urn", "field_path", F.col("native_type").alias("now")), "dataset_urn")
    rows = old.join(new, ["run_urn", "dataset_urn", "field_path"], "full_outer").where(~F.col("trained").eqNullSafe(F.col("now")))
    kind = F.when(F.col("trained").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("retyped")
    return rows.join(model_runs.select("model_urn", "run_urn"), "run_urn").select("model_urn", "run_urn", "dataset_urn", "field_path", "trained", "now", kind.alias("kind"))


def schema_drift(changes: DataFrame, refs: DataFrame) -> DataFrame:
    """A finding for each model, run and input whose schema differs."""
    label = text.diff_label("field_path", "trained", "now")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "retyped")]
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("field_path", label.alias("d")))), lambda x: x["d"]), ", ").alias("drifted_fields")
    rows = changes.groupBy("model_urn", "run_urn", "dataset_urn").agg(*counts, listed).join(refs.select("model_urn", F.col("name").alias("model_name"), "is_live"), "model_urn")
    title = F.concat(F.lit("Training-serving schema drift in "), urn.dataset_name("dataset_urn"), F.lit(" for "), F.col("model_name"))
    return rows.select(F.lit("input_schema_drift").alias("finding_type"), "model_urn", "model_name", "is_live", "run_urn", F.col("dataset_urn").alias("resource_urn"), "added", "removed", "retyped", "drifted_fields", title.alias("title"), rules.severity(F.lit("input_schema_drift"), F.col("is_live")).alias("severity"))


def deprecated_inputs(inputs: DataFrame, deprecations: DataFrame, refs: DataFrame) -> DataFrame:
    """Inputs whose deprecation is in force; a withdrawn one is healthy."""
    on = deprecations.where("deprecated").select(F.col("entity_urn").alias("dataset_urn"), "note", "decommission_time_ms")
    rows = inputs.join(on, "dataset_urn").join(refs.select("model_urn", F.col("name").alias("model_name"), "is_live"), "model_urn")
    title = F.concat(F.lit("Deprecated training input "), urn.dataset_name("dataset_urn"), F.lit(" for "), F.col("model_name"))
    return rows.select(F.lit("deprecated_input").alias("finding_type"), "model_urn", "model_name", "is_live", F.col("dataset_urn").alias("resource_urn"), F.nullif("note", F.lit("")).alias("note"), "decommission_time_ms", title.alias("title"), rules.severity(F.lit("deprecated_input"), F.col("is_live")).alias("severity"))


def training_tables(inputs: DataFrame, model_lineage: DataFrame) -> DataFrame:
    """Run inputs and the datasets one hop upstream of the model (model_urn, dataset_urn)."""
    return inputs.unionByName(model_lineage.select("model_urn", "dataset_urn")).distinct()


def table_level_risks(tables: DataFrame, linked: DataFrame, refs: DataFrame, stale: DataFrame, deprecations: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Risks of training tables, only for models none of whose features has a source column.

    sensitive: (column_urn, marker_urn); the table's own columns alone count.
    """
    only = tables.join(linked.select("model_urn").distinct(), "model_urn", "left_anti")
    classified = sensitive.select(urn.field_parent("column_urn").alias("dataset_urn"), urn.field_path("column_urn").alias("f")).groupBy("dataset_urn").agg(F.array_join(F.sort_array(F.collect_set("f")), ",").alias("detail"))
    parts = [
        stale.select("dataset_urn", F.lit("stale").alias("risk"), F.format_string("%.1f", "lag_hours").alias("detail")),
        deprecations.where("deprecated").select(F.col("entity_urn").alias("dataset_urn"), F.lit("deprecated").alias("risk"), F.coalesce("note", F.lit("")).alias("detail")),
        classified.select("dataset_urn", F.lit("classified").alias("risk"), "detail"),
    ]
    risks = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = only.join(risks, "dataset_urn").join(refs.select("model_urn", F.col("name").alias("model_name"), "is_live"), "model_urn")
    title = F.concat(F.lit("Table-level "), F.col("risk"), F.lit(" input "), urn.dataset_name("dataset_urn"), F.lit(" for "), F.col("model_name"), F.lit(" (no column link)"))
    return rows.select(F.lit("table_level_risk").alias("finding_type"), "model_urn", "model_name", "is_live", F.col("dataset_urn").alias("resource_urn"), "risk", "detail", F.lit(0.25).alias("mode_precision"), title.alias("title"), rules.severity(F.lit("table_level_risk"), F.col("is_live")).alias("severity"))


def table_level_leakage(features: DataFrame, table_lineage: DataFrame, labels: DataFrame, hops: int) -> DataFrame:
    """Features whose source table, or any table upstream of it, holds a label column: the coarse baseline."""
    labelled = labels.select(urn.field_parent("column_urn").alias("node")).distinct()
    tables = features.where("source_dataset_urn is not null").select(F.col("source_dataset_urn").alias("dataset_urn")).distinct()
    starts = tables.select(F.col("dataset_urn").alias("root"), F.col("dataset_urn").alias("node"))
    up = table_lineage.select(F.col("downstream_urn").alias("src"), F.col("upstream_urn").alias("dst"))
    bad = walk.reach(starts, up, hops).join(labelled, "node", "left_semi").select(F.col("root").alias("source_dataset_urn")).distinct()
    return features.join(bad, "source_dataset_urn", "left_semi").select("feature_urn")
