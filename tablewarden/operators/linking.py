"""Proposing, checking and replaying links between models, feature tables and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urn

#: Run parameters that may name the training table, most specific first.
PARAMETER_KEYS = ["feature_table", "dataset", "dataset_name", "training_data", "training_table", "input_table", "table"]


def named_by_parameters(model_runs: DataFrame, run_properties: DataFrame, datasets: DataFrame) -> DataFrame:
    """(model_urn, key, dataset_urn): tables that a run parameter names, by the first key of PARAMETER_KEYS that names any.

    Of several runs the first that has a parameter counts, keys in lower case. The last part of a value between slashes
    must be a table's name or the last dotted part of it.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in PARAMETER_KEYS]), F.lower("key"))
    said = model_runs.select("model_urn", "run_urn", "pos").join(run_properties, "run_urn").withColumn("rank", rank).where("rank > 0 and value is not null")
    first = said.groupBy("model_urn", "rank").agg(F.min_by("value", F.struct("pos", "run_urn", "key", "value")).alias("value"))
    first = first.withColumn("asked", F.element_at(F.split(F.trim(F.trim("value"), F.lit("/")), "/"), -1)).where("asked <> ''")
    endings = datasets.select("dataset_urn", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))).alias("asked"))
    hit = first.join(endings, "asked")
    best = hit.groupBy("model_urn").agg(F.min("rank").alias("rank"))
    key = F.element_at(F.array(*[F.lit(k) for k in PARAMETER_KEYS]), F.col("rank").cast("int"))
    return hit.join(best, ["model_urn", "rank"]).select("model_urn", key.alias("key"), "dataset_urn").distinct()


#: Candidates that a model with no table gets.
SHORTLIST = 5


def infer_feature_table(refs: DataFrame, model_runs: DataFrame, run_inputs: DataFrame, run_properties: DataFrame, model_lineage: DataFrame, datasets: DataFrame) -> DataFrame:
    """(model_urn, dataset_urn, route, key, candidates): where each model's features come from, and how that was decided.

    The single input of its runs, else the single table that a run parameter names (key), else the single table that
    lineage declares upstream of the model (model_lineage: model_urn, dataset_urn). A kind with several tables chooses
    none: if no other kind has one table, the first kind's tables are candidates of the route `ambiguous`. With no table
    at all the route is `none`, and candidates are the first SHORTLIST tables that share a name word with the model.
    """
    every = lambda df, name: df.groupBy("model_urn").agg(F.array_sort(F.collect_set("dataset_urn")).alias(name))
    inputs = every(model_runs.select("model_urn", "run_urn").join(run_inputs.select("run_urn", "dataset_urn"), "run_urn"), "inputs")
    said = named_by_parameters(model_runs, run_properties, datasets)
    named = said.groupBy("model_urn").agg(F.array_sort(F.collect_set("dataset_urn")).alias("named"), F.first("key").alias("said"))
    above = every(model_lineage, "above")
    rows = refs.select("model_urn", "name").join(inputs, "model_urn", "left").join(named, "model_urn", "left").join(above, "model_urn", "left")
    kinds = ["inputs", "named", "above"]
    single = [F.when(F.size(k) == 1, k) for k in kinds]
    known = F.coalesce(*[F.col(k) for k in kinds])
    route = F.coalesce(*[F.when(s.isNotNull(), name) for s, name in zip(single, ["run input", "run parameter", "lineage"])], F.when(known.isNotNull(), "ambiguous"), F.lit("none"))
    rows = rows.withColumn("route", route)
    table = F.when(route == "run input", F.get("inputs", F.lit(0))).when(route == "run parameter", F.get("named", F.lit(0))).when(route == "lineage", F.get("above", F.lit(0)))
    listed = shortlist(rows.where("route = 'none'").select("model_urn", "name"), datasets, SHORTLIST).groupBy("model_urn").agg(F.array_sort(F.collect_list("dataset_urn")).alias("listed"))
    rows = rows.join(listed, "model_urn", "left")
    none = F.array().cast("array<string>")
    candidates = F.when(F.col("route") == "ambiguous", known).when(F.col("route") == "none", F.coalesce("listed", none)).otherwise(none)
    return rows.select("model_urn", table.alias("dataset_urn"), "route", F.when(F.col("route") == "run parameter", F.col("said")).alias("key"), candidates.alias("candidates"))


def shortlist(refs: DataFrame, datasets: DataFrame, keep: int = SHORTLIST) -> DataFrame:
    """(model_urn, dataset_urn, place): the first `keep` datasets by URN that share a name word with a model.

    They are among the first `keep` of each word, so only those are joined, however many datasets have a word.
    """
    words = lambda df, name: df.withColumn("word", F.explode(text.name_tokens(name)))
    held = words(datasets.select("dataset_urn", F.col("name").alias("table")), "table").select("word", "dataset_urn").distinct()
    held = held.withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy("dataset_urn"))).where(F.col("nth") <= keep)
    shared = words(refs.select("model_urn", "name"), "name").join(held, "word").select("model_urn", "dataset_urn").distinct()
    return shared.withColumn("place", F.row_number().over(Window.partitionBy("model_urn").orderBy("dataset_urn"))).where(F.col("place") <= keep)


#: What a proposal says of its table, by the route.
TABLE_REASONS = {
    "run input": "the only input of the model's runs",
    "run parameter": "named by a run parameter, which is a habit and no declaration: ",
    "lineage": "the only table that lineage has upstream of the model",
    "ambiguous": "several tables, choose one of the candidates",
    "none": "runs, parameters and lineage tell of no table",
}


def propose_links(found: DataFrame, labels: DataFrame, excluded: DataFrame) -> DataFrame:
    """(model_urn, dataset_urn, label_column_urn, excluded, reasons, candidates, complete): a whole proposal for each model.

    found: infer_feature_table(); labels: infer_label_column(); excluded: infer_excluded(). One reason for each decision, in
    the order table, label, exclusions. Without a table nothing else is inferred, and only then are there candidates. A
    proposal is complete when table and label are known.
    """
    out = excluded.groupBy("dataset_urn").agg(F.array_sort(F.collect_set("column_urn")).alias("excluded"))
    rows = found.join(labels.select("dataset_urn", F.col("column_urn").alias("label_column_urn"), F.col("reason").alias("why")), "dataset_urn", "left").join(out, "dataset_urn", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("excluded", F.coalesce("excluded", none))
    said = F.lit(None).cast("string")
    for route, words in TABLE_REASONS.items():
        said = F.when(F.col("route") == route, F.concat(F.lit(words), F.coalesce("key", F.lit("")))).otherwise(said)
    known = F.col("dataset_urn").isNotNull()
    label = F.when(~known, "not inferred without a table").otherwise(F.coalesce("why", F.lit("no column is marked, derives from a label or has its name")))
    n = F.size("excluded")
    keys = F.when(~known, "not inferred without a table").when(n == 0, "no declared key").otherwise(F.concat(n.cast("string"), F.lit(" declared keys and labels")))
    reasons = F.array(F.concat(F.lit("table: "), said), F.concat(F.lit("label: "), label), F.concat(F.lit("excluded: "), keys))
    return rows.select("model_urn", "dataset_urn", "label_column_urn", "excluded", reasons.alias("reasons"), "candidates", (known & F.col("label_column_urn").isNotNull()).alias("complete"))


def infer_label_column(columns: DataFrame, marks: DataFrame, ancestors: DataFrame, names: list[str]) -> DataFrame:
    """(dataset_urn, column_urn, reason): a column with the label mark, else one with a marked ancestor, else one of the given names."""
    rows = columns.select("dataset_urn", "column_urn", "field_path", "ordinal").join(marks.select("column_urn", F.lit(1).alias("m")), "column_urn", "left").join(ancestors.select(F.col("root").alias("column_urn"), F.lit(1).alias("a")).distinct(), "column_urn", "left")
    reason = F.when(F.col("m") == 1, 1).when(F.col("a") == 1, 2).when(F.lower("field_path").isin(*names), 3)
    best = rows.withColumn("r", reason).where("r is not null").groupBy("dataset_urn").agg(F.min_by(F.struct("column_urn", "r"), F.struct("r", "ordinal")).alias("b"))
    return best.select("dataset_urn", "b.column_urn", F.element_at(F.array(F.lit("marked"), F.lit("derived from label"), F.lit("name")), F.col("b.r")).alias("reason"))


def infer_excluded(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """(dataset_urn, column_urn): declared keys, and the label when it lives in the table; never by name."""
    keys = columns.where("is_primary_key or is_part_of_key or is_partitioning_key").select("dataset_urn", "column_urn")
    return keys.unionByName(labels.select("dataset_urn", "column_urn")).distinct()


def link_features(links: DataFrame, columns: DataFrame, excluded: DataFrame) -> DataFrame:
    """(model_urn, feature_urn, column_urn): features of the linked tables' columns that are not excluded."""
    rows = links.join(columns.select("dataset_urn", "column_urn", "field_path"), "dataset_urn").join(excluded, ["model_urn", "field_path"], "left_anti")
    return rows.select("model_urn", F.concat(F.lit("urn:li:mlFeature:("), urn.dataset_name("dataset_urn"), F.lit(","), "field_path", F.lit(")")).alias("feature_urn"), "column_urn")


def declared_check(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(table, column, problem): excluded columns stand only in the table, missing ones only in the declaration."""
    return declared.withColumn("d", F.lit(1)).join(actual.withColumn("t", F.lit(1)), ["table", "column"], "full_outer").where("d is null or t is null").select("table", "column", F.when(F.col("d").isNull(), "excluded").otherwise("missing").alias("problem"))


def declarations_agree(declared: DataFrame) -> DataFrame:
    """(model, sources, agree): whether all sources of a model name the same columns; declared: (model, source, column)."""
    sets = declared.groupBy("model", "source").agg(F.array_sort(F.collect_set("column")).alias("c"))
    return sets.groupBy("model").agg(F.count(F.lit(1)).alias("sources"), (F.count_distinct("c") == 1).alias("agree"))


def recorded_links(properties: DataFrame) -> DataFrame:
    """(model_urn, feature_table, label_column, excluded): models whose properties hold both a table and a label."""
    at = lambda p: F.max(F.when(F.col("property") == p, F.col("value"))).alias(p)
    return properties.groupBy(F.col("entity_urn").alias("model_urn")).agg(at("feature_table"), at("label_column"), at("excluded")).where("feature_table is not null and label_column is not null")


def capture_schema(links: DataFrame, model_runs: DataFrame, columns: DataFrame, training: DataFrame) -> DataFrame:
    """Training schemas after each run of a linked model took a snapshot of its table's whole schema; others stay."""
    taken = links.join(model_runs.select("model_urn", "run_urn"), "model_urn").select("run_urn", "dataset_urn").distinct()
    fresh = taken.join(columns.select("dataset_urn", "field_path", "native_type"), "dataset_urn").select("run_urn", "dataset_urn", "field_path", "native_type")
    return training.join(taken, ["run_urn", "dataset_urn"], "left_anti").unionByName(fresh)


def contract_rows(inputs: DataFrame, columns: DataFrame) -> DataFrame:
    """(model_urn, dataset_urn, field_path, physical_type, logical_type, required): the input contract of each model."""
    return inputs.join(columns, "dataset_urn").select("model_urn", "dataset_urn", "field_path", F.col("native_type").alias("physical_type"), text.logical_type("native_type").alias("logical_type"), (~F.col("nullable")).alias("required"))
