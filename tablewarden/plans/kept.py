"""Queries of what is kept between scans, and of measures that add up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, upkeep
from ..operators.steps import shared_dir
from ..sources.state import KeyedState
from .fixture import PII, oracle
from .scoring import Scored, audit_of
from .upkeep import EVERY, resources

QUERIES, SQL = {}, {}
#: Models that the later scan is about.
SCANNED = "c_custkey % 4 <> 0"


def query(name: str, sql: str, extra: dict[str, str] | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(audit_of(spark, sf_dir))
        SQL[name] = oracle(sql, EVERY | (extra or {}))
        return f

    return add


PARTS = {
    "scanned": f"SELECT model_urn FROM {{models}} WHERE {SCANNED}",
    "raised": """SELECT incident_urn, resource_urn, title, state, CASE WHEN title LIKE 'Target leakage: %' THEN 'target_leakage' ELSE 'sensitive_source' END AS finding_type FROM {leak_incidents}
        UNION ALL SELECT incident_urn, resource_urn, title, state, finding_type FROM {ours}""",
    "candidates": """SELECT resource_urn FROM {resources} WHERE model_urn IN (SELECT model_urn FROM {scanned})
        UNION SELECT resource_urn FROM {recorded_leaks} WHERE model_urn IN (SELECT model_urn FROM {scanned})""",
}
RESOLVED = """
SELECT incident_urn, resource_urn, finding_type FROM {raised} o
WHERE state = 'ACTIVE' AND finding_type IS NOT NULL AND resource_urn IN (SELECT resource_urn FROM {candidates}) AND NOT EXISTS (
    SELECT 1 FROM {findings} f WHERE f.resource_urn = o.resource_urn AND f.finding_type = o.finding_type
    AND (f.title = o.title OR o.finding_type IN ('target_leakage', 'sensitive_source')))
"""


@query("j26_resolved_incidents", RESOLVED, PARTS)
def resolved(a: Scored) -> DataFrame:
    """An earlier scan recorded leak columns; some are gone from the schema, and their incidents close all the same."""
    spark, scanned = a.t.models.sparkSession, a.t.models.where(SCANNED).select("model_urn")
    schema = spark.createDataFrame([], "model_urn string, columns array<string>, run long").schema
    memory = KeyedState(spark, f"{shared_dir(spark)}/leaks-{uuid.uuid4().hex}", schema, ["model_urn"], "run")
    memory.add(upkeep.leak_columns(a.t.recorded_leaks, a.t.models, F.lit(1).cast("long")))
    candidates = upkeep.incident_candidates(resources(a), memory.rows(), scanned)
    columns = ["incident_urn", "resource_urn", "title", "state"]
    raised = a.t.incidents.select(*columns).unionByName(a.t.leak_incidents.select(*columns))
    return upkeep.resolved_incidents(raised, a.findings, candidates)


MEMBERS = {
    "had": "SELECT column_urn, list(marker_urn ORDER BY pos, marker_urn) AS members FROM {column_marks} GROUP BY ALL",
    "asked": f"""SELECT column_urn, '{PII}' AS member, 'remove' AS op FROM {{schema_fields}} WHERE ordinal % 2 = 0
        UNION ALL SELECT column_urn, 'urn:li:tag:reviewed', 'add' FROM {{schema_fields}} WHERE k % 7 = 0 AND k % 3 <> 0 UNION ALL SELECT column_urn, 'urn:li:tag:other', 'add' FROM {{schema_fields}} WHERE k % 5 = 0""",
    "adds": "SELECT column_urn, list(DISTINCT member ORDER BY member) AS l FROM {asked} WHERE op = 'add' GROUP BY ALL",
    "merged": f"""SELECT coalesce(h.column_urn, a.column_urn) AS entity_urn, coalesce(h.members, []) AS had, list_filter(coalesce(a.l, []), lambda x: NOT list_contains(coalesce(h.members, []), x)) AS added,
        coalesce(h.column_urn, a.column_urn) IN (SELECT column_urn FROM {{asked}} WHERE op = 'remove') AND list_contains(coalesce(h.members, []), '{PII}') AS removes FROM {{had}} h FULL JOIN {{adds}} a ON a.column_urn = h.column_urn""",
}
CHANGED = f"""
SELECT entity_urn, array_to_string(list_concat(CASE WHEN removes THEN list_filter(had, lambda x: x <> '{PII}') ELSE had END, added), ' ') AS members, len(added)::INT AS added, removes::INT AS removed, len(added) > 0 OR removes AS changed
FROM {{merged}} WHERE len(had) > 0 OR len(added) > 0
"""


@query("s9_remove_member", CHANGED, MEMBERS)
def members(a: Scored) -> DataFrame:
    """Marks of columns after single marks were added and taken away; an intent that a later one takes back does nothing."""
    had = a.t.column_marks.groupBy(F.col("column_urn").alias("entity_urn")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "marker_urn"))), lambda x: x["marker_urn"]).alias("members"))
    fields = a.t.schema_fields
    intent = lambda rows, member, op, seq: rows.select(F.col("column_urn").alias("entity_urn"), F.lit(member).alias("member"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))
    intents = intent(fields.where("ordinal % 2 = 0"), PII, "remove", 1).unionByName(intent(fields.where("k % 7 = 0"), "urn:li:tag:reviewed", "add", 1))
    intents = intents.unionByName(intent(fields.where("k % 21 = 0"), "urn:li:tag:reviewed", "remove", 2)).unionByName(intent(fields.where("k % 5 = 0"), "urn:li:tag:other", "add", 1))
    rows = upkeep.change_members(had, intents).where("size(members) > 0 or changed")
    return rows.select("entity_urn", F.array_join("members", " ").alias("members"), F.size("added").alias("added"), F.size("removed").alias("removed"), "changed")


_BOUNDS = quality.BOUNDS_MS
_OVER = ", ".join(f"count(CASE WHEN ms > {low} AND ms <= {high} THEN 1 END)" for low, high in zip(_BOUNDS, _BOUNDS[1:]))
METRICS = f"""
SELECT dry_run, count(*) AS scans, sum(findings)::BIGINT AS findings, sum(ms)::BIGINT AS sum_ms, min(ms) AS least_ms, max(ms) AS most_ms,
    array_to_string([count(CASE WHEN ms <= {_BOUNDS[0]} THEN 1 END), {_OVER}, count(CASE WHEN ms > {_BOUNDS[-1]} THEN 1 END)], ' ') AS buckets
FROM (SELECT event_type = 'error' AS dry_run, user_id % 7 AS findings, floor(value * 10)::BIGINT AS ms FROM {{events}} WHERE value IS NOT NULL) x GROUP BY ALL
"""


@query("a16_scan_metrics", METRICS)
def metrics(a: Scored) -> DataFrame:
    """Log lines, one for each event: those with a value tell of a scan. Metrics of each day are added up."""
    told = F.to_json(F.struct((F.col("event_type") == "error").alias("dry_run"), (F.col("user_id") % 7).alias("findings"), F.floor(F.col("value") * 10).alias("detect_ms")))
    lines = a.t.events.select(F.to_date("ts").alias("day"), told.alias("line"))
    scans = quality.scan_records(lines.select("line"))
    days = quality.partial_metrics(scans.withColumn("part", F.col("detect_ms") % 5), "part", "dry_run")
    return quality.merge_metrics(days, "dry_run").withColumn("buckets", F.array_join("buckets", " "))


AUC = """
SELECT sum(n * (2 * below + same))::DOUBLE / (2.0 * any_value(tp) * any_value(tn)) AS auc, any_value(tp)::BIGINT AS p, any_value(tn)::BIGINT AS n FROM (
    SELECT pos AS n, neg AS same, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM (
        SELECT -n_chars AS s, count(CASE WHEN quality = 0 THEN 1 END) AS pos, count(CASE WHEN quality = 1 THEN 1 END) AS neg FROM {labels} JOIN {documents} USING (doc_id) GROUP BY ALL) x) y
"""


@query("a20_roc_auc", AUC)
def auc(a: Scored) -> DataFrame:
    rows = a.t.labels.join(a.t.documents, "doc_id").select((-F.col("n_chars")).alias("s"), (1 - F.col("quality")).alias("y"))
    return quality.roc_auc(rows, "s", "y")
