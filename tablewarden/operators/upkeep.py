"""Unused tables, incident lifecycles, incident updates and merges by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text, urn

FINDING_TYPES = list(text.TITLE_PREFIXES)


def model_usage(models: DataFrame, refs: DataFrame, now_ms: int, idle_limit: float) -> DataFrame:
    """(model_urn, idle_days, unused, undated): no live deployment and idle strictly longer than the limit; undated is never unused."""
    idle = rules.idle_days(rules.last_touched("created_ms", "last_modified_ms", "date_ms"), now_ms)
    rows = models.select("model_urn", idle.alias("idle_days")).join(refs.select("model_urn", "is_live"), "model_urn")
    return rows.select("model_urn", "idle_days", (~F.col("is_live") & F.coalesce(F.col("idle_days") > idle_limit, F.lit(False))).alias("unused"), F.col("idle_days").isNull().alias("undated"))


def feeding_datasets(inputs: DataFrame, upstream: DataFrame) -> DataFrame:
    """(model_urn, dataset_urn): inputs and all that lies upstream of them."""
    above = inputs.join(upstream, inputs["dataset_urn"] == upstream["root"]).select("model_urn", F.col("node").alias("dataset_urn"))
    return inputs.select("model_urn", "dataset_urn").unionByName(above).distinct()


def orphaned_inputs(feeding: DataFrame, usage: DataFrame) -> DataFrame:
    """Datasets every model of which is unused, with those models."""
    rows = feeding.join(usage.select("model_urn", "unused"), "model_urn").groupBy("dataset_urn")
    return rows.agg(F.bool_and("unused").alias("orphan"), F.sort_array(F.collect_list("model_urn")).alias("models")).where("orphan").drop("orphan")


def model_resources(inputs: DataFrame, snapshots: DataFrame, linked: DataFrame, upstream: DataFrame) -> DataFrame:
    """(model_urn, resource_urn): what a scan of a model may raise an incident on."""
    feeding = feeding_datasets(inputs, upstream).select("model_urn", F.col("dataset_urn").alias("resource_urn"))
    return feeding.unionByName(snapshots.select("model_urn", F.col("dataset_urn").alias("resource_urn"))).unionByName(linked.select("model_urn", F.col("source").alias("resource_urn"))).distinct()


def read_lifecycles(incidents: DataFrame, resources: DataFrame) -> DataFrame:
    """Our incidents on the resources, once each: (incident_urn, finding_type, created_ms, resolved_ms, run_id)."""
    ours = incidents.withColumn("run_id", text.run_id("description")).withColumn("finding_type", text.classify_title("title")).where("run_id is not null and finding_type is not null")
    hit = ours.join(resources.select("resource_urn").distinct(), "resource_urn", "left_semi").dropDuplicates(["incident_urn"])
    return hit.select("incident_urn", "finding_type", "created_ms", F.when(F.col("state") == "RESOLVED", F.col("updated_ms")).alias("resolved_ms"), "run_id")


def mttr_by_type(lifecycles: DataFrame) -> DataFrame:
    """A row for each finding type: raised, open, resolved with a duration of 0 or more, and its mean and exact median in hours."""
    kinds = lifecycles.sparkSession.createDataFrame([(k,) for k in FINDING_TYPES], "finding_type string")
    hours = (F.col("resolved_ms") - F.col("created_ms")) / 3_600_000.0
    rows = lifecycles.withColumn("hours", F.when(hours >= 0, hours))
    found = rows.groupBy("finding_type").agg(F.count(F.lit(1)).alias("raised"), F.count_if(F.col("resolved_ms").isNull()).alias("open"), F.count("hours").alias("resolved"), F.avg("hours").alias("mean_hours"), F.percentile("hours", 0.5).alias("median_hours"))
    return kinds.join(found, "finding_type", "left").na.fill(0, ["raised", "open", "resolved"])


KEYS = ["resource_urn", "incident_type", "title"]


def new_incidents(findings: DataFrame, incidents: DataFrame, datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Findings without an active incident of the same key, on datasets and columns that exist (never on models)."""
    active = incidents.where("state = 'ACTIVE'").select("resource_urn", F.col("type").alias("incident_type"), "title")
    exists = datasets.select(F.col("dataset_urn").alias("resource_urn")).unionByName(columns.select(F.col("column_urn").alias("resource_urn")))
    return findings.select(*KEYS).distinct().join(active, KEYS, "left_anti").join(exists, "resource_urn", "left_semi")


def leak_columns(leaks: DataFrame, scanned: DataFrame, run: Column) -> DataFrame:
    """(model_urn, columns, run): the columns through which each scanned model leaks now; none when it does not.

    Kept by model, the last run counting, this is what a later scan knows of columns that may be gone by then.
    """
    now = leaks.groupBy("model_urn").agg(F.sort_array(F.collect_set("resource_urn")).alias("columns"))
    return scanned.select("model_urn").distinct().join(now, "model_urn", "left").select("model_urn", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), run.alias("run"))


def incident_candidates(resources: DataFrame, memory: DataFrame, scanned: DataFrame) -> DataFrame:
    """(resource_urn): what incidents of the scanned models may stand on: their resources now and their recorded leak columns."""
    known = memory.join(scanned.select("model_urn"), "model_urn", "left_semi").select(F.explode("columns").alias("resource_urn"))
    return resources.join(scanned.select("model_urn"), "model_urn", "left_semi").select("resource_urn").unionByName(known).distinct()


def resolved_incidents(incidents: DataFrame, findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """Active incidents of ours on scanned resources (incident_candidates()) that no finding reproduces.

    Findings about columns match by resource and type, as their titles name a path end that may move; the others by title.
    """
    ours = incidents.where("state = 'ACTIVE'").withColumn("finding_type", text.classify_title("title")).where("finding_type is not null").join(scanned.select("resource_urn").distinct(), "resource_urn", "left_semi")
    loose = F.col("finding_type").isin("target_leakage", "sensitive_source")
    key = F.when(loose, "").otherwise(F.col("title"))
    now = findings.select("resource_urn", "finding_type", key.alias("k")).distinct()
    return ours.withColumn("k", key).join(now, ["resource_urn", "finding_type", "k"], "left_anti").select("incident_urn", "resource_urn", "finding_type")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Merge by key: changed columns win when not null, others stay; `changed` is false for rows that stay as they were."""
    values = [c for c in current.columns if c not in keys]
    c = changes.select(*keys, *[F.col(v).alias(f"_{v}") for v in changes.columns if v not in keys], F.lit(True).alias("_hit"))
    given = [v for v in values if v in changes.columns]
    rows = current.withColumn("_had", F.lit(True)).join(c, keys, "full_outer")
    differs = [F.col(f"_{v}").isNotNull() & ~F.col(f"_{v}").eqNullSafe(F.col(v)) for v in given]
    changed = F.col("_had").isNull()
    for d in differs:
        changed = changed | d
    return rows.select(*keys, *[F.coalesce(f"_{v}", v).alias(v) if v in given else F.col(v) for v in values], F.coalesce(changed, F.lit(False)).alias("changed"))


def change_members(current: DataFrame, intents: DataFrame) -> DataFrame:
    """(entity_urn, members, added, removed, changed): arrays after single members were added or taken away.

    current: (entity_urn, members); intents: (entity_urn, member, op, seq) with op `add` or `remove`; of several about
    one member the last by seq counts. A remove takes that member alone; the others stay in their order, and added ones
    follow by name. Adding what is there and removing what is not change nothing. Null members are no intents.
    """
    last = intents.where("member is not null").groupBy("entity_urn", "member").agg(F.max_by("op", F.struct("seq", "op")).alias("op"))
    of = lambda op: F.array_sort(F.collect_list(F.when(F.col("op") == op, F.col("member"))))
    asked = last.groupBy("entity_urn").agg(of("add").alias("adds"), of("remove").alias("removes"))
    none = F.array().cast("array<string>")
    rows = current.join(asked, "entity_urn", "full_outer")
    had, adds, removes = (F.coalesce(c, none) for c in ("members", "adds", "removes"))
    rows = rows.select("entity_urn", had.alias("had"), F.array_except(adds, had).alias("added"), F.array_intersect(removes, had).alias("removed"))
    rows = rows.select("entity_urn", F.concat(F.filter("had", lambda m: ~F.array_contains("removed", m)), "added").alias("members"), "added", "removed")
    return rows.withColumn("changed", (F.size("added") > 0) | (F.size("removed") > 0))


def owned_issues(owners: DataFrame, incidents: DataFrame, assertions: DataFrame, deprecations: DataFrame, cap: int) -> DataFrame:
    """(owner_urn, entity_urn, issue, rank): issues on the first `cap` entities of each owner, worst source first."""
    first = Window.partitionBy("owner_urn").orderBy("entity_urn")
    held = owners.withColumn("n", F.row_number().over(first)).where(F.col("n") <= cap).drop("n")
    parts = [
        incidents.where("state = 'ACTIVE'").select(F.col("resource_urn").alias("entity_urn"), F.lit("incident").alias("issue"), F.lit(0).alias("rank")),
        assertions.where("result_type = 'FAILURE'").select(F.col("assertee_urn").alias("entity_urn"), F.lit("failing assertion"), F.lit(1)),
        deprecations.where("deprecated").select("entity_urn", F.lit("deprecated"), F.lit(2)),
    ]
    return held.join(parts[0].union(parts[1]).union(parts[2]).distinct(), "entity_urn").select("owner_urn", "entity_urn", "issue", "rank")


def guarding_assertions(stale: DataFrame, sla_hours: float) -> DataFrame:
    """An assertion for each stale table, with a stable id, and its failing run; only limits between 0 and 24 hours can be declared."""
    return stale.where(F.lit(0 < sla_hours < 24)).select(text.stable_id(F.lit("freshness"), "dataset_urn").alias("assertion_id"), "dataset_urn", F.lit(sla_hours).alias("sla_hours"), F.lit("FAILURE").alias("result"), "lag_hours")


def scan_runs(events: DataFrame) -> DataFrame:
    """(run_id, inputs, status, duration_ms) of runs from their touched entities and start and end stamps."""
    rows = events.withColumn("iolet", urn.touched_entity("entity_urn")).groupBy("run_id")
    return rows.agg(F.count_distinct("iolet").alias("inputs"), F.when(F.bool_or("failed"), "FAILURE").otherwise("SUCCESS").alias("status"), F.greatest(F.max("ts_ms") - F.min("ts_ms"), F.lit(0)).alias("duration_ms"))
