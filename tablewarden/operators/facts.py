"""What is known of findings, features and models, as rows: evidence, remedies, provenance, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urn
from ..sources.state import KeyedState
from . import coverage, models, walk
from .steps import cut

#: What is told of each finding type, by name and expression.
EVIDENCE = {
    "target_leakage": {"feature": "feature_name", "label": "ancestor", "path": "path_text", "paths": "1 + n_other_paths", "live": "is_live"},
    "sensitive_source": {"feature": "feature_name", "class": "marker_urn", "column": "ancestor", "path": "path_text", "paths": "1 + n_other_paths", "live": "is_live"},
    "proxy_candidate": {"feature": "feature_name", "protected": "protected", "class": "marker_urn", "ancestor": "ancestor", "hops_up": "up_hops", "hops_down": "down_hops"},
    "input_schema_drift": {"run": "run_urn", "added": "added", "removed": "removed", "retyped": "retyped", "fields": "drifted_fields"},
    "deprecated_input": {"note": "note", "decommission_ms": "decommission_time_ms", "live": "is_live"},
    "table_level_risk": {"risk": "risk", "detail": "detail", "live": "is_live"},
}


def evidence(rows: DataFrame, told: dict[str, str]) -> DataFrame:
    """(finding_type, model_urn, resource_urn, title, evidence): a map from name to text; what is null is left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(f"cast({e} as string)").alias("value")) for k, e in told.items()])
    known = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return rows.select("finding_type", "model_urn", "resource_urn", "title", known.alias("evidence"))


def evidence_of_radii(radii: DataFrame) -> DataFrame:
    """Evidence of stale tables, which belong to no single model: hours with one decimal."""
    told = {"lag_hours": F.format_string("%.1f", "lag_hours"), "sla_hours": F.format_string("%.1f", "sla_hours"), "models_at_risk": F.col("n_models").cast("string"), "live_models_at_risk": F.col("n_live_models").cast("string"), "severity": F.col("severity")}
    pairs = F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)])
    return radii.select(F.lit("upstream_freshness").alias("finding_type"), F.lit(None).cast("string").alias("model_urn"), "resource_urn", "title", pairs.alias("evidence"))


def lines_of(pairs: Column) -> Column:
    """A map as text, sorted by name."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(pairs), lambda p: F.concat(p["key"], F.lit("="), p["value"]))), "; ")


def cut_edges(matches: DataFrame) -> DataFrame:
    """(root, edge): the first edge of every path of a root; none for a root that is marked itself."""
    own = matches.where(F.size("path") < 2).select("root").distinct()
    return matches.join(own, "root", "left_anti").select("root", F.concat(F.get("path", F.lit(0)), F.lit("<-"), F.get("path", F.lit(1))).alias("edge")).distinct()


def signature_sets(findings: DataFrame) -> DataFrame:
    """(model_urn, n, signature): the set of (type, resource, title, severity) of a model, in order."""
    key = F.concat_ws("|", "finding_type", "resource_urn", "title", "severity")
    return findings.groupBy("model_urn").agg(F.array_sort(F.collect_set(key)).alias("signature")).select("model_urn", F.size("signature").alias("n"), "signature")


def first_entities(owners: DataFrame, cap: int = 200) -> DataFrame:
    """(owner_urn, entity_urn, capped): the first `cap` entities of each owner, and whether there were as many."""
    rows = owners.select("owner_urn", "entity_urn").distinct()
    counts = rows.groupBy("owner_urn").agg((F.count(F.lit(1)) >= cap).alias("capped"))
    place = F.row_number().over(Window.partitionBy("owner_urn").orderBy("entity_urn"))
    return rows.withColumn("place", place).where(F.col("place") <= cap).drop("place").join(counts, "owner_urn")


def remedies(findings: dict[str, DataFrame], matches: dict[str, DataFrame]) -> DataFrame:
    """(finding_type, model_urn, resource_urn, title, remedy, cut_edges): what would clear each finding.

    Findings of column lineage name the first edges of all their paths; the others act on a table, a feature or a mark.
    """
    said = {
        "target_leakage": "cut the lineage or drop the feature",
        "sensitive_source": "cut the lineage, drop the feature or review the mark",
        "proxy_candidate": "drop the feature or test it for bias",
        "input_schema_drift": "retrain on the current schema or restore the fields",
        "deprecated_input": "move to the replacement or withdraw the deprecation",
        "table_level_risk": "link features to columns, then check again",
    }
    none = F.array().cast("array<string>")
    out = []
    for kind, rows in findings.items():
        if kind in matches:
            edges = cut_edges(matches[kind]).groupBy(F.col("root").alias("resource_urn")).agg(F.array_sort(F.collect_set("edge")).alias("cut_edges"))
            rows = rows.join(edges, "resource_urn", "left").withColumn("cut_edges", F.coalesce("cut_edges", none))
        else:
            rows = rows.withColumn("cut_edges", none)
        out.append(rows.select("finding_type", "model_urn", "resource_urn", "title", F.lit(said[kind]).alias("remedy"), "cut_edges"))
    return reduce(DataFrame.unionByName, out)


def chain_counts(columns: DataFrame, lineage: DataFrame) -> DataFrame:
    """(column_urn, chains): upstream paths of one to three edges that visit no column twice, none of them built.

    Walks are counted from the counts of the neighbours, a hop at a time, and those that return are taken off: of two
    edges the returns to the start, of three those that return after two edges, or repeat their second column, or
    close a triangle; walks to and fro, which do both of the first, are taken off once.
    """
    e = cut(lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst")).where("src <> dst").distinct())
    back = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("back"))
    one = e.groupBy("src").agg(F.count(F.lit(1)).alias("one"))
    node = one.join(back, "src", "left").na.fill(0, ["back"])
    two = e.join(node.select(F.col("src").alias("dst"), "one", "back"), "dst").groupBy("src").agg(F.sum("one").alias("two"), F.sum("back").alias("back_after"))
    node = cut(node.join(two, "src", "left").na.fill(0, ["two", "back_after"]))
    three = e.join(node.select(F.col("src").alias("dst"), "two"), "dst").groupBy("src").agg(F.sum("two").alias("three"))
    starts = columns.select(F.col("column_urn").alias("root")).distinct()
    first = starts.join(e, F.col("root") == F.col("src")).select("root", F.col("dst").alias("b"))
    last = e.join(starts, F.col("dst") == F.col("root"), "left_semi").select(F.col("src").alias("c"), F.col("dst").alias("root"))
    closed = first.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").join(last, ["root", "c"]).groupBy("root").agg(F.count(F.lit(1)).alias("closed"))
    rows = starts.join(node.withColumnRenamed("src", "root"), "root", "left").join(three.withColumnRenamed("src", "root"), "root", "left").join(closed, "root", "left")
    rows = rows.na.fill(0, ["one", "two", "three", "back", "back_after", "closed"])
    return rows.select(F.col("root").alias("column_urn"), F.expr("one + (two - back) + (three - back * one - back_after - closed + back)").alias("chains"))


def crossed_tables(sources: DataFrame, lineage: DataFrame, latest: DataFrame, stale: DataFrame) -> DataFrame:
    """(source, tables): every table within three edges upstream of a column, its own among them, each with its state.

    Only columns with an edge above them are walked; for the others their own table is all.
    """
    up = lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst"))
    starts = sources.join(up.select(F.col("src").alias("source")).distinct(), "source", "left_semi").select(F.col("source").alias("root"), F.col("source").alias("node"))
    above = walk.reach(starts, up, 3).where("hops > 0").select(F.col("root").alias("source"), urn.field_parent("node").alias("dataset_urn"))
    crossed = above.unionByName(sources.select("source", urn.field_parent("source").alias("dataset_urn")))
    state = latest.select("dataset_urn", F.lit("fresh").alias("known")).join(stale.select("dataset_urn", F.lit("stale").alias("late")), "dataset_urn", "left")
    said = F.concat(urn.dataset_name("dataset_urn"), F.lit(":"), F.coalesce("late", "known", F.lit("unknown")))
    return crossed.join(state, "dataset_urn", "left").groupBy("source").agg(F.array_sort(F.collect_set(said)).alias("tables"))


def provenance(model_features: DataFrame, features: DataFrame, sources: DataFrame, lineage: DataFrame, classes: DataFrame, below: DataFrame, shared: DataFrame, latest: DataFrame, stale: DataFrame, known: DataFrame, model_runs: DataFrame, training_schema: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Facts of every feature of every model, as sorted texts where they are sets.

    sources: (source), the source columns of all features, once each. chains: derivations of one to three edges of its source column. tables: every table that they cross, its own among
    them, each fresh, stale or unknown. classes: marks with how many columns upstream carry them, from classes (root, node,
    marker_urn). training_type: type of the column in the last run of the model that took a snapshot of it; current_type: its
    type now; drifted: both are known and differ. findings: types found for a model of `known` on the column, which are those
    of column lineage: they belong to the column (below: walk.below(), shared: columns.shared_protected()), whatever the model.
    gaps: what could not be told. A feature without a source column has no other fact.
    """
    valid = models.source_columns(features).select("feature_urn", "source").repartition("feature_urn").distinct()
    asked = model_features.select("model_urn", "feature_urn").repartition("feature_urn").distinct()
    rows = asked.join(valid, "feature_urn", "left").withColumns({"dataset_urn": urn.field_parent("source"), "field_path": urn.field_path("source")})
    crossed = crossed_tables(sources, lineage, latest, stale)
    per = classes.groupBy("root", "marker_urn").agg(F.count_distinct("node").alias("n"))
    marks = per.groupBy(F.col("root").alias("source")).agg(F.array_sort(F.collect_set(F.concat("marker_urn", F.lit(":"), "n"))).alias("classes"))
    chains = chain_counts(sources.withColumnRenamed("source", "column_urn"), lineage).withColumnRenamed("column_urn", "source")
    parts = sources.select("source", urn.field_parent("source").alias("dataset_urn"), urn.field_path("source").alias("field_path"))
    now = parts.join(schema_fields.select("dataset_urn", "field_path", F.col("native_type").alias("current_type")), ["dataset_urn", "field_path"]).select("source", "current_type")
    kinds = [below.select(F.col("node").alias("source"), F.when(F.col("root") == "label", "target_leakage").otherwise("sensitive_source").alias("kind")), shared.select("source", F.lit("proxy_candidate").alias("kind"))]
    found = kinds[0].unionByName(kinds[1]).groupBy("source").agg(F.array_sort(F.collect_set("kind")).alias("found"))
    for part in (crossed, marks, chains, now, found):
        sources = sources.join(part, "source", "left")
    taken = training_schema.select("run_urn", "dataset_urn", "field_path", "native_type").join(model_runs.select("model_urn", "run_urn", "pos"), "run_urn")
    trained = taken.groupBy("model_urn", "dataset_urn", "field_path").agg(F.max_by("native_type", F.struct("pos", "run_urn", "native_type")).alias("training_type"))
    known = known.select("model_urn", F.lit(True).alias("is_known")).distinct()
    rows = rows.join(trained, ["model_urn", "dataset_urn", "field_path"], "left").drop("dataset_urn", "field_path").join(known, "model_urn", "left").join(sources, "source", "left")
    rows = rows.withColumn("findings", F.when(F.col("is_known"), F.col("found")))
    gap = F.when(F.col("source").isNull(), "no source column").otherwise(F.concat_ws("; ", F.when(F.col("training_type").isNull(), "no training type"), F.when(F.col("current_type").isNull(), "no current type")))
    text = lambda c: F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c)
    drifted = F.coalesce(F.col("training_type") != F.col("current_type"), F.lit(False))
    return rows.select("model_urn", "feature_urn", "source", F.coalesce("chains", F.lit(0)).alias("chains"), *[text(c) for c in ("tables", "classes")], "training_type", "current_type", drifted.alias("drifted"), text("findings"), gap.alias("gaps"))


def properties_of(model_runs: DataFrame, run_properties: DataFrame) -> DataFrame:
    """(model_urn, properties): metrics and parameters of a model's runs; without a name or a value they are left out."""
    rows = model_runs.select("model_urn", "run_urn").join(run_properties.where("key is not null and key <> '' and value is not null"), "run_urn")
    return rows.groupBy("model_urn").agg(F.array_join(F.array_sort(F.collect_set(F.concat("key", F.lit("="), "value"))), "; ").alias("properties"))


def reports(models: DataFrame, datasets: DataFrame, findings: DataFrame, scores: DataFrame, gaps: DataFrame, violations: DataFrame, radii: DataFrame, warnings: DataFrame) -> DataFrame:
    """(target, report): one JSON document for each model and each table, with findings or none, keys in a fixed order.

    A model's findings are those that endanger it, with its score, its gaps, what its gate says and the caps that cut its
    walks; a table's finding is that it is stale, with what P28 warns of its radius. What was not scored is null.
    """
    some = ["severity_rank", "title", "resource_urn", "finding_type", "severity"]
    own = findings.select(F.col("model_urn").alias("target"), *some)
    stale = radii.select(F.col("resource_urn").alias("target"), rules.severity_rank("severity").alias("severity_rank"), "title", "resource_urn", "finding_type", "severity")
    listed = own.unionByName(stale).groupBy("target").agg(F.array_sort(F.collect_list(F.struct(*some))).alias("findings"))
    missing = gaps.groupBy(F.col("model_urn").alias("target")).agg(F.array_sort(F.collect_list(F.struct("check", "reason", coverage.remedy().alias("remedy")))).alias("gaps"))
    cuts = gaps.where(F.contains("reason", F.lit("cap"))).select(F.col("model_urn").alias("target"), F.concat("check", F.lit(": "), "reason").alias("warning"))
    said = cuts.unionByName(warnings.where("warning is not null").select(F.col("resource_urn").alias("target"), "warning"))
    said = said.groupBy("target").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    broken = violations.groupBy(F.col("model_urn").alias("target")).agg(F.array_sort(F.collect_list(F.struct("rule", "detail"))).alias("violations"))
    trust = scores.select(F.col("model_urn").alias("target"), F.struct("score", "band", F.transform("deductions", lambda d: d["name"]).alias("deductions")).alias("trust"))
    rows = models.select(F.col("model_urn").alias("target"), F.lit("model").alias("kind")).unionByName(datasets.select(F.col("dataset_urn").alias("target"), F.lit("table").alias("kind")))
    for part in (listed, missing, said, broken, trust):
        rows = rows.join(part, "target", "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    rows = rows.select("target", "kind", *[none(c) for c in ("findings", "gaps", "warnings", "violations")], "trust")
    worst = F.get("findings", F.lit(0))["severity"]
    gate = F.when(F.col("kind") == "model", F.struct((F.size("violations") > 0).alias("blocked"), F.when(F.size("violations") > 0, 1).otherwise(0).alias("exit_code"), "violations"))
    document = F.struct("target", "kind", (F.size("findings") == 0).alias("clean"), worst.alias("severity"), "findings", "trust", "gaps", "warnings", gate.alias("gate"))
    return rows.select("target", F.to_json(document, {"ignoreNullFields": "false"}).alias("report"))


def keep_reports(reports: DataFrame, root: str, run: str, targets: DataFrame | None = None) -> DataFrame:
    """(target, run_no, run, report): the last document of every target ever scanned, after those of a scan were written.

    targets: (target) that the scan is about, by default all of `reports`; the documents of other targets stay as they were.
    """
    scanned = reports if targets is None else reports.join(targets.select("target").distinct(), "target", "left_semi")
    schema = reports.sparkSession.createDataFrame([], "target string, run_no long, run string, report string").schema
    store = KeyedState(reports.sparkSession, root, schema, ["target"], "run_no")
    number = store.pointer()["epoch"] + 1
    store.merge(scanned.select("target", F.lit(number).cast("long").alias("run_no"), F.lit(run).alias("run"), "report"), number)
    return store.rows()
