"""Queries of evidence, remedies, provenance, facts and reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, models, score, walk
from ..operators.findings import radius_warnings
from ..operators.steps import cut, shared_dir
from ..sources import log
from .detection import CHAINS, RADIUS_WARNINGS
from .oracle_parts import dsname
from .scalars import FIELD_RE, SLA
from .upkeep import EVERY
from .fixture import oracle
from .scoring import Scored, audit_of

QUERIES, SQL = {}, {}
KINDS = {"target_leakage": "leaks", "sensitive_source": "exposures", "proxy_candidate": "proxies", "input_schema_drift": "drifts", "deprecated_input": "deprecated", "table_level_risk": "table_risks"}


def query(name: str, sql: str, extra: dict[str, str] | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(audit_of(spark, sf_dir))
        SQL[name] = oracle(sql, EVERY | (extra or {}))
        return f

    return add


def _found(a: Scored) -> dict[str, DataFrame]:
    return {kind: getattr(a, part) for kind, part in KINDS.items()}


def _told(kind: str) -> str:
    told = facts.EVIDENCE[kind]
    parts = ", ".join(f"'{k}=' || ({e.replace('n_other_paths', '(n_matches - 1)')})::VARCHAR" for k, e in sorted(told.items()))
    return f"SELECT finding_type, model_urn, resource_urn, title, concat_ws('; ', {parts}) AS evidence FROM {{{KINDS[kind]}}}"


RADII = f"SELECT 'upstream_freshness', NULL, resource_urn, title, concat_ws('; ', 'lag_hours=' || printf('%.1f', lag_hours), 'live_models_at_risk=' || n_live_models, 'models_at_risk=' || n_models, 'severity=' || severity, 'sla_hours={SLA:.1f}') FROM {{radii}}"


@query("p11_finding_evidence", " UNION ALL ".join([*map(_told, KINDS), RADII]))
def evidence(a: Scored) -> DataFrame:
    rows = [facts.evidence(found, facts.EVIDENCE[kind]) for kind, found in _found(a).items()]
    every = reduce(DataFrame.unionByName, [*rows, facts.evidence_of_radii(a.radii)])
    return every.withColumn("evidence", facts.lines_of(F.col("evidence")))


@query("a12_finding_signature", "SELECT model_urn, count(DISTINCT k)::INT AS n, string_agg(DISTINCT k, chr(10) ORDER BY k) AS signature FROM (SELECT model_urn, finding_type || '|' || resource_urn || '|' || title || '|' || severity AS k FROM {findings}) x GROUP BY ALL")
def finding_signature(a: Scored) -> DataFrame:
    return facts.signature_sets(a.findings).withColumn("signature", F.array_join("signature", "\n"))


@query("t5_entity_cap", "SELECT owner_urn, entity_urn, n >= 200 AS capped FROM (SELECT *, row_number() OVER (PARTITION BY owner_urn ORDER BY entity_urn) AS place, count(*) OVER (PARTITION BY owner_urn) AS n FROM (SELECT DISTINCT owner_urn, entity_urn FROM {owners}) o) x WHERE place <= 200")
def entity_cap(a: Scored) -> DataFrame:
    return facts.first_entities(a.t.owners)


def _remedy(kind: str, text: str) -> str:
    matches = {"target_leakage": "label_matches", "sensitive_source": "class_matches"}.get(kind)
    edges = "''" if matches is None else f"coalesce((SELECT string_agg(DISTINCT m.path[1] || '<-' || m.path[2], ' ' ORDER BY m.path[1] || '<-' || m.path[2]) FROM {{{matches}}} m WHERE m.root = f.resource_urn AND m.root NOT IN (SELECT root FROM {{{matches}}} WHERE len(path) < 2)), '')"
    return f"SELECT finding_type, model_urn, resource_urn, title, '{text}' AS remedy, {edges} AS cut_edges FROM {{{KINDS[kind]}}} f"


SAID = {
    "target_leakage": "cut the lineage or drop the feature",
    "sensitive_source": "cut the lineage, drop the feature or review the mark",
    "proxy_candidate": "drop the feature or test it for bias",
    "input_schema_drift": "retrain on the current schema or restore the fields",
    "deprecated_input": "move to the replacement or withdraw the deprecation",
    "table_level_risk": "link features to columns, then check again",
}


@query("a14_counterfactual", " UNION ALL ".join(_remedy(k, t) for k, t in SAID.items()))
def counterfactual(a: Scored) -> DataFrame:
    found = facts.remedies(_found(a), {"target_leakage": a.label_matches, "sensitive_source": a.class_matches})
    return found.withColumn("cut_edges", F.array_join("cut_edges", " "))


def _parent(column: str) -> str:
    return f"regexp_extract({column}, '{FIELD_RE}', 1)"


CROSSED = {
    "chain_nodes": "SELECT DISTINCT root, unnest(path) AS node FROM {recursive_chains}",
    "crossed": f"SELECT DISTINCT root, {_parent('node')} AS ds FROM {{chain_nodes}}",
    "crossed_text": f"""SELECT root, {dsname('ds')} || ':' || CASE WHEN ds IN (SELECT dataset_urn FROM {{stale}}) THEN 'stale'
        WHEN ds IN (SELECT dataset_urn FROM {{latest_op}}) THEN 'fresh' ELSE 'unknown' END AS t FROM {{crossed}}""",
    "class_counts": "SELECT root, marker_urn || ':' || count(DISTINCT ancestor) AS t FROM {class_matches} GROUP BY root, marker_urn",
    "source_parts": f"SELECT source, {_parent('source')} AS ds, regexp_extract(source, '{FIELD_RE}', 2) AS field FROM {{sources}}",
    "trained": """SELECT r.model_urn, p.source, max_by(t.native_type, (r.pos, r.run_urn, t.native_type)) AS v
        FROM {model_runs} r JOIN {training_schema} t ON t.run_urn = r.run_urn JOIN {source_parts} p ON p.ds = t.dataset_urn AND p.field = t.field_path GROUP BY ALL""",
    "now_type": "SELECT p.source, f.native_type AS v FROM {source_parts} p JOIN {schema_fields} f ON f.dataset_urn = p.ds AND f.field_path = p.field",
    "own_features": "SELECT DISTINCT m.model_urn, m.feature_urn, l.source FROM {model_features} m LEFT JOIN {linked} l ON l.model_urn = m.model_urn AND l.feature_urn = m.feature_urn",
}
PROVENANCE = """
SELECT o.model_urn, o.feature_urn, o.source, coalesce(c.n, 0) AS chains, coalesce(t.v, '') AS tables, coalesce(k.v, '') AS classes, y.v AS training_type, w.v AS current_type,
    coalesce(y.v <> w.v, false) AS drifted, coalesce(f.v, '') AS findings,
    CASE WHEN o.source IS NULL THEN 'no source column' ELSE concat_ws('; ', CASE WHEN y.v IS NULL THEN 'no training type' END, CASE WHEN w.v IS NULL THEN 'no current type' END) END AS gaps
FROM {own_features} o
LEFT JOIN (SELECT root, count(*) AS n FROM {recursive_chains} WHERE len(path) >= 2 GROUP BY ALL) c ON c.root = o.source
LEFT JOIN (SELECT root, string_agg(DISTINCT t, '; ' ORDER BY t) AS v FROM {crossed_text} GROUP BY ALL) t ON t.root = o.source
LEFT JOIN (SELECT root, string_agg(t, '; ' ORDER BY t) AS v FROM {class_counts} GROUP BY ALL) k ON k.root = o.source
LEFT JOIN {trained} y ON y.model_urn = o.model_urn AND y.source = o.source
LEFT JOIN {now_type} w ON w.source = o.source
LEFT JOIN (SELECT model_urn, resource_urn, string_agg(DISTINCT finding_type, '; ' ORDER BY finding_type) AS v FROM {findings} GROUP BY ALL) f ON f.model_urn = o.model_urn AND f.resource_urn = o.source
"""


@query("j33_feature_provenance", PROVENANCE, CHAINS | CROSSED)
def feature_provenance(a: Scored) -> DataFrame:
    t = a.t
    sources = cut(models.source_columns(t.features).select("source").distinct())
    classes = walk.first_marked(sources.withColumnRenamed("source", "column_urn"), t.column_lineage, a.marks(*a.CLASSES), a.below.where("root = 'class'"), a.column_hops)
    return facts.provenance(t.model_features, t.features, sources, t.column_lineage, classes, a.below, a.shared, log.latest_operation(t.operations), a.stale, t.models, t.model_runs, t.training_schema, t.schema_fields)


COUNTS = {"features": "model_features", "with_source": "linked", "runs": "model_runs", "inputs": "inputs", "findings": "findings", "gaps": "gaps"}


@query(
    "j34_model_facts",
    "SELECT m.model_urn, " + ", ".join(f"coalesce({k}.n, 0) AS {k}" for k in COUNTS) + ", coalesce(r.n_snapshots, 0) AS snapshots, coalesce(p.v, '') AS properties, b.score FROM {models} m "
    + " ".join(f"LEFT JOIN (SELECT model_urn, count(*) AS n FROM {{{t}}} GROUP BY ALL) {k} ON {k}.model_urn = m.model_urn" for k, t in COUNTS.items())
    + " LEFT JOIN {run_facts} r ON r.model_urn = m.model_urn LEFT JOIN {banded} b ON b.model_urn = m.model_urn LEFT JOIN (SELECT model_urn, string_agg(DISTINCT key || '=' || value, '; ' ORDER BY key || '=' || value) AS v FROM {model_runs} r JOIN {run_properties} q ON q.run_urn = r.run_urn WHERE value IS NOT NULL GROUP BY ALL) p ON p.model_urn = m.model_urn",
)
def model_facts(a: Scored) -> DataFrame:
    rows = a.t.models.select("model_urn")
    taken = a.t.model_runs.select("model_urn", "run_urn").join(a.t.training_snapshots.select("run_urn").distinct(), "run_urn")
    counted = {name: part.groupBy("model_urn").agg(F.count(F.lit(1)).alias(name)) for name, part in {"runs": a.t.model_runs, "inputs": a.inputs, "gaps": a.gaps, "snapshots": taken}.items()}
    counted["features"] = a.feature_tally.select("model_urn", "features", "with_source")
    counted["findings"] = a.model_tally.groupBy("model_urn").agg(F.sum("n").alias("findings"))
    for part in counted.values():
        rows = rows.join(part, "model_urn", "left")
    rows = rows.na.fill(0).join(facts.properties_of(a.t.model_runs, a.t.run_properties), "model_urn", "left").na.fill("", ["properties"])
    rows = rows.join(a.points, "model_urn", "left")
    return rows.select("model_urn", *COUNTS, "snapshots", "properties", "score")


REPORTS = """
SELECT r.target, to_json(struct_pack(target := r.target, kind := r.kind, clean := f.l IS NULL, severity := f.l[1].severity, findings := coalesce(f.l, []),
    trust := CASE WHEN b.model_urn IS NOT NULL THEN struct_pack(score := b.score, band := b.band, deductions := list_transform(b.d, lambda x: x.name)) END,
    gaps := coalesce(g.l, []), warnings := coalesce(w.l, []),
    gate := CASE WHEN r.kind = 'model' THEN struct_pack(blocked := v.l IS NOT NULL, exit_code := (v.l IS NOT NULL)::INT, violations := coalesce(v.l, [])) END))::VARCHAR AS report
FROM (SELECT model_urn AS target, 'model' AS kind FROM {models} UNION ALL SELECT dataset_urn, 'table' FROM {datasets}) r
LEFT JOIN (SELECT target, list(struct_pack(severity_rank := severity_rank::INT, title := title, resource_urn := resource_urn, finding_type := finding_type, severity := severity)
        ORDER BY severity_rank, title, resource_urn, finding_type) AS l
    FROM (SELECT model_urn AS target, severity_rank, title, resource_urn, finding_type, severity FROM {findings}
        UNION ALL SELECT resource_urn, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, title, resource_urn, finding_type, severity FROM {radii}) x GROUP BY ALL) f ON f.target = r.target
LEFT JOIN {banded} b ON b.model_urn = r.target
LEFT JOIN (SELECT model_urn, list(struct_pack("check" := "check", reason := reason, remedy := remedy) ORDER BY "check", reason) AS l FROM {cures} GROUP BY ALL) g ON g.model_urn = r.target
LEFT JOIN (SELECT target, list(DISTINCT warning ORDER BY warning) AS l FROM (SELECT model_urn AS target, "check" || ': ' || reason AS warning FROM {gaps} WHERE contains(reason, 'cap')
        UNION ALL SELECT resource_urn, warning FROM ({radius_warnings}) p WHERE warning IS NOT NULL) x GROUP BY ALL) w ON w.target = r.target
LEFT JOIN (SELECT model_urn, list(struct_pack(rule := rule, detail := detail) ORDER BY rule, detail) AS l FROM {violations} GROUP BY ALL) v ON v.model_urn = r.target
"""


@query("s8_report_json", REPORTS.replace("({radius_warnings})", f"({RADIUS_WARNINGS})"))
def report_json(a: Scored) -> DataFrame:
    violations = score.gate_violations(a.findings, a.scores, "high", 40)
    warnings = radius_warnings(a.radii, a.reached, 20, 3)
    made = facts.reports(a.t.models, a.t.datasets, a.findings, a.scores, a.gaps, violations, a.radii, warnings)
    root = f"{shared_dir(a.t.models.sparkSession)}/reports-{uuid.uuid4().hex}"
    return facts.keep_reports(made, root, "first").select("target", "report")
