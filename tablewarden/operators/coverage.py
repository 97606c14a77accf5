"""What could not be checked, and how far a catalog is covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Checks in their order.
CHECKS = ["target_leakage", "schema_drift", "sensitive_source", "deprecated_input", "proxy_candidate"]
FOUND_AS = {"target_leakage": "target_leakage", "input_schema_drift": "schema_drift", "sensitive_source": "sensitive_source", "deprecated_input": "deprecated_input", "proxy_candidate": "proxy_candidate"}


def model_gaps(models: DataFrame, features: DataFrame, recorded: DataFrame, model_runs: DataFrame, run_inputs: DataFrame, snapshots: DataFrame, found: DataFrame, marks_known: bool = True) -> DataFrame:
    """(model_urn, check, reason): checks of a model that could not be made; the first reason that fits.

    features: (model_urn, n_features, n_sources, truncated, hop_capped), as tally.of_features(); found: (model_urn, check)
    that produced a finding and so are no gap.
    """
    feats = features.select("model_urn", "n_features", "n_sources", "truncated", "hop_capped")
    links = recorded.where("feature_dataset_urn is not null and label_column_urn is not null").select("model_urn").distinct().withColumn("was_linked", F.lit(True))
    runs = model_runs.join(run_inputs.select("run_urn").distinct().withColumn("i", F.lit(1)), "run_urn", "left").join(snapshots.select("run_urn").distinct().withColumn("s", F.lit(1)), "run_urn", "left")
    runs = runs.groupBy("model_urn").agg(F.count(F.lit(1)).alias("n_runs"), F.count("i").alias("n_inputs"), F.count("s").alias("n_snapshots"))
    rows = models.select("model_urn")
    for part in (feats, links, runs):
        rows = rows.join(part, "model_urn", "left")
    rows = rows.na.fill(0, ["n_features", "n_sources", "n_runs", "n_inputs", "n_snapshots"]).na.fill(False, ["truncated", "hop_capped", "was_linked"])
    rows = rows.select("*", F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"))
    column_walk = (
        F.when((F.col("n_features") == 0) & F.col("was_linked"), "de-linked")
        .when(F.col("n_features") == 0, "no features")
        .when(F.lit(not marks_known), "no marks configured")
        .when(F.col("check") == "proxy_candidate", None)
        .when(F.col("n_sources") == 0, "no source columns")
        .when(F.col("n_sources") < F.col("n_features"), F.concat((F.col("n_features") - F.col("n_sources")).cast("string"), F.lit(" of "), F.col("n_features").cast("string"), F.lit(" features have no source column")))
        .when(F.col("truncated") & F.col("hop_capped"), "result cap and hop cap")
        .when(F.col("truncated"), "result cap")
        .when(F.col("hop_capped"), "hop cap")
    )
    runs_only: Column = F.when(F.col("n_runs") == 0, "no training run")
    reason = F.when(F.col("check") == "schema_drift", F.coalesce(runs_only, F.when(F.col("n_snapshots") == 0, "no input with a snapshot"))).when(F.col("check") == "deprecated_input", F.coalesce(runs_only, F.when(F.col("n_inputs") == 0, "runs record no inputs"))).otherwise(column_walk)
    return rows.select("model_urn", "check", reason.alias("reason")).where("reason is not null").join(found, ["model_urn", "check"], "left_anti")


def remedy() -> Column:
    """What would close a gap; gaps with one cure share it."""
    r = F.col("reason")
    return F.when(r.isin("no features", "de-linked"), "declare the model's features").when(r.contains("source column"), "ingest column lineage").when(r.contains("cap"), "raise the cap").when(r == "no input with a snapshot", "record the training schema").otherwise("record training runs with inputs")


def freshness_gaps(datasets: DataFrame, latest: DataFrame) -> DataFrame:
    """Tables whose last change is unknown."""
    return datasets.select("dataset_urn").join(latest.select("dataset_urn"), "dataset_urn", "left_anti").withColumn("reason", F.lit("no operation"))


def guard_coverage(gaps: DataFrame, models: DataFrame) -> DataFrame:
    """(check, covered, total, rate): all checks and a row for all together; without models the rates are 0."""
    spark = gaps.sparkSession
    total = models.agg(F.count_distinct("model_urn").alias("total"))
    checks = spark.createDataFrame([(c,) for c in CHECKS], "check string").crossJoin(total)
    missing = gaps.groupBy("check").agg(F.count_distinct("model_urn").alias("missing"))
    rows = checks.join(missing, "check", "left").select("check", (F.col("total") - F.coalesce("missing", F.lit(0))).alias("covered"), "total")
    both = rows.rollup("check").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    return both.select(F.coalesce("check", F.lit("all")).alias("check"), "covered", "total", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0).alias("rate"))


def next_join(gaps: DataFrame) -> DataFrame:
    """The remedy that opens most (model, check) pairs; then most models, then the greatest text; with its models.

    Models are listed for that remedy alone, after it is known.
    """
    rows = gaps.select(remedy().alias("remedy"), "model_urn", "check").distinct().groupBy("remedy", "model_urn").agg(F.count(F.lit(1)).alias("pairs"))
    best = rows.groupBy("remedy").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("n_models"))
    best = best.orderBy(F.desc("pairs"), F.desc("n_models"), F.desc("remedy")).limit(1)
    models = rows.join(F.broadcast(best.select("remedy")), "remedy").groupBy("remedy").agg(F.sort_array(F.collect_list("model_urn")).alias("models"))
    return best.join(models, "remedy")
