"""Common table expressions that oracle queries share."""

from __future__ import annotations

from .fixture import AGE, GENDER, LABEL, NOW_MS, PII, SECRET
from .scalars import DATASET_RE, FIELD_RE, LATEST_OP, NAME_SQL, SLA


def marker_sql(*markers: str) -> str:
    listed = ", ".join(f"'{m}'" for m in markers)
    return f"SELECT column_urn, marker_urn FROM (SELECT *, row_number() OVER (PARTITION BY column_urn ORDER BY origin <> 'editable', kind <> 'term', pos, marker_urn) AS rn FROM {{column_marks}} WHERE marker_urn IN ({listed})) x WHERE rn = 1"


def walk_sql(name: str, markers: str, hops: int) -> str:
    return f"""SELECT source AS root, [source] AS path, source AS node, 0 AS hops, mk.marker_urn FROM {{sources}} LEFT JOIN {{{markers}}} mk ON mk.column_urn = source
        UNION ALL SELECT w.root, list_append(w.path, e.upstream_column_urn), e.upstream_column_urn, w.hops + 1, mk.marker_urn FROM {{{name}}} w JOIN {{column_lineage}} e ON e.downstream_column_urn = w.node LEFT JOIN {{{markers}}} mk ON mk.column_urn = e.upstream_column_urn
        WHERE w.marker_urn IS NULL AND w.hops < {hops} AND NOT list_contains(w.path, e.upstream_column_urn)"""


def reach_sql(name: str, starts: str, edges: str, hops: int) -> str:
    """All (root, node, hops) walks; take the least hops of each pair."""
    return f"SELECT root, node, 0 AS hops FROM {{{starts}}} UNION SELECT w.root, e.dst, w.hops + 1 FROM {{{name}}} w JOIN {{{edges}}} e ON e.src = w.node WHERE w.hops < {hops}"


def field(x: str) -> str:
    return f"regexp_extract({x}, '{FIELD_RE}', 2)"


def dsname(x: str) -> str:
    return f"regexp_extract({x}, '{DATASET_RE}', 2)"


PATH_TEXT = f"array_to_string(list_filter(list_transform(path, lambda x: {field('x')}), lambda x, i: i = 1 OR x <> {field('path[i - 1]')}), ' <- ')"

PARTS = {
    "refs": f"SELECT m.model_urn, {NAME_SQL.replace('model_urn', 'm.model_urn')} AS name, count(DISTINCT md.deployment_urn) AS n_deployments, count(DISTINCT CASE WHEN d.status = 'IN_SERVICE' THEN md.deployment_urn END) AS n_live, count(CASE WHEN d.status = 'IN_SERVICE' THEN 1 END) > 0 AS is_live, m.model_urn IN (SELECT entity_urn FROM {{owners}}) AS has_owner FROM {{models}} m LEFT JOIN {{model_deployments}} md ON md.model_urn = m.model_urn LEFT JOIN {{deployments}} d ON d.deployment_urn = md.deployment_urn GROUP BY m.model_urn, m.name",
    "linked": f"SELECT mf.model_urn, f.feature_urn, f.feature_name, mf.pos, f.source_column_urn AS source FROM {{model_features}} mf JOIN {{features}} f ON f.feature_urn = mf.feature_urn WHERE regexp_matches(f.source_column_urn, '{FIELD_RE}')",
    "sources": "SELECT DISTINCT source FROM {linked}",
    "label_marks": marker_sql(LABEL),
    "class_marks": marker_sql(PII, SECRET, AGE, GENDER),
    "sensitive_marks": marker_sql(PII, SECRET),
    "protected_marks": marker_sql(AGE, GENDER),
    "recursive_label": walk_sql("recursive_label", "label_marks", 6),
    "recursive_class": walk_sql("recursive_class", "class_marks", 6),
    "label_matches": "SELECT root, path, node AS ancestor, marker_urn FROM {recursive_label} WHERE marker_urn IS NOT NULL",
    "class_matches": "SELECT root, path, node AS ancestor, marker_urn FROM {recursive_class} WHERE marker_urn IS NOT NULL",
    "up_edges": "SELECT DISTINCT downstream_column_urn AS src, upstream_column_urn AS dst FROM {column_lineage}",
    "down_edges": "SELECT DISTINCT upstream_column_urn AS src, downstream_column_urn AS dst FROM {column_lineage}",
    "source_starts": "SELECT source AS root, source AS node FROM {sources}",
    "recursive_cone": reach_sql("recursive_cone", "source_starts", "up_edges", 7),
    "cone": "SELECT root, node, min(hops) AS hops FROM {recursive_cone} GROUP BY root, node",
    "latest_op": LATEST_OP,
    "stale": f"SELECT dataset_urn, last_updated_ms, ({NOW_MS} - last_updated_ms) / 3600000.0::DOUBLE AS lag_hours FROM {{latest_op}} WHERE ({NOW_MS} - last_updated_ms) / 3600000.0::DOUBLE > {SLA}",
    "all_edges": "SELECT upstream_urn AS src, downstream_urn AS dst FROM {table_lineage} UNION SELECT source_dataset_urn, feature_urn FROM {features} UNION SELECT feature_urn, model_urn FROM {model_features}",
    "stale_starts": "SELECT dataset_urn AS root, dataset_urn AS node FROM {stale}",
    "recursive_radius": reach_sql("recursive_radius", "stale_starts", "all_edges", 3),
    "reached": "SELECT root, node, min(hops) AS hops, split_part(node, ':', 3) AS kind FROM {recursive_radius} WHERE node <> root GROUP BY root, node",
    "risk": "SELECT r.root, mf.model_urn, count(DISTINCT mf.feature_urn) AS n FROM {reached} r JOIN {model_features} mf ON mf.feature_urn = r.node GROUP BY ALL",
    "radius": "SELECT r.root, r.node AS model_urn, r.hops, f.name, f.n_deployments, f.n_live, f.is_live, f.has_owner, coalesce(k.n, 0) AS features_at_risk, CASE WHEN f.is_live THEN 'critical' WHEN f.n_deployments > 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN f.is_live THEN 0 WHEN f.n_deployments > 0 THEN 1 ELSE 2 END AS severity_rank FROM {reached} r JOIN {refs} f ON f.model_urn = r.node LEFT JOIN {risk} k ON k.root = r.root AND k.model_urn = r.node",
    "inputs": "SELECT DISTINCT r.model_urn, i.dataset_urn FROM {model_runs} r JOIN {run_inputs} i ON i.run_urn = r.run_urn",
    "drift_base": "SELECT DISTINCT r.model_urn, i.run_urn, i.dataset_urn FROM {model_runs} r JOIN {run_inputs} i ON i.run_urn = r.run_urn JOIN {training_snapshots} s ON s.run_urn = i.run_urn AND s.dataset_urn = i.dataset_urn",
    "changes": """SELECT model_urn, run_urn, dataset_urn, field_path, max(a) AS trained, max(b) AS now, CASE WHEN max(a) IS NULL THEN 'added' WHEN max(b) IS NULL THEN 'removed' ELSE 'retyped' END AS kind FROM (
        SELECT b.*, t.field_path, t.native_type AS a, NULL AS b FROM {drift_base} b JOIN {training_schema} t ON t.run_urn = b.run_urn AND t.dataset_urn = b.dataset_urn
        UNION ALL SELECT b.*, f.field_path, NULL, f.native_type FROM {drift_base} b JOIN {schema_fields} f ON f.dataset_urn = b.dataset_urn) x GROUP BY model_urn, run_urn, dataset_urn, field_path HAVING max(a) IS DISTINCT FROM max(b)""",
    "recorded_links_used": "SELECT model_urn, feature_dataset_urn AS dataset_urn FROM {recorded_links} WHERE feature_dataset_urn IS NOT NULL",
    "tables_of": "SELECT model_urn, dataset_urn FROM {inputs} UNION SELECT model_urn, dataset_urn FROM {recorded_links_used}",
    "risks": f"""SELECT dataset_urn, 'stale' AS risk, printf('%.1f', lag_hours) AS detail FROM {{stale}} UNION ALL SELECT entity_urn, 'deprecated', coalesce(note, '') FROM {{deprecations}} WHERE deprecated
        UNION ALL SELECT regexp_extract(column_urn, '{FIELD_RE}', 1), 'classified', string_agg(DISTINCT {field('column_urn')}, ',' ORDER BY {field('column_urn')}) FROM {{sensitive_marks}} GROUP BY 1""",
}


def best_sql(matches: str) -> str:
    return f"SELECT root, path, ancestor, marker_urn, count(*) OVER (PARTITION BY root) AS n_matches, row_number() OVER (PARTITION BY root ORDER BY len(path), ancestor, array_to_string(path, '|')) AS rn FROM {{{matches}}}"


def derived_sql(kind: str, matches: str) -> str:
    title = f"'Target leakage: ' || {field('source')} || ' derives from label ' || {field('ancestor')}" if kind == "target_leakage" else f"'Sensitive source: ' || {field('source')} || ' derives from ' || list_last(string_split(marker_urn, ':')) || ' column ' || {field('ancestor')}"
    high, low = ("critical", "high") if kind == "target_leakage" else ("high", "medium")
    return f"""SELECT '{kind}' AS finding_type, l.model_urn, f.name AS model_name, f.is_live, l.feature_urn, l.feature_name, source AS resource_urn, ancestor, marker_urn, path, n_matches, {PATH_TEXT} AS path_text, {title} AS title,
        CASE WHEN f.is_live THEN '{high}' ELSE '{low}' END AS severity FROM {{linked}} l JOIN ({best_sql(matches)}) b ON b.root = l.source AND b.rn = 1 JOIN {{refs}} f ON f.model_urn = l.model_urn"""


PARTS |= {
    "leaks": derived_sql("target_leakage", "label_matches"),
    "exposures": derived_sql("sensitive_source", "class_matches"),
    "clear_starts": "SELECT source AS root, source AS node FROM {sources} WHERE source NOT IN (SELECT root FROM {class_matches})",
    "recursive_above": reach_sql("recursive_above", "clear_starts", "up_edges", 3),
    "protected_starts": "SELECT column_urn AS root, column_urn AS node FROM {protected_marks}",
    "recursive_below": reach_sql("recursive_below", "protected_starts", "up_edges", 3),
    "forks": """SELECT a.root, b.root AS protected, a.node AS ancestor, a.h AS up_hops, b.h AS down_hops, row_number() OVER (PARTITION BY a.root, b.root ORDER BY a.h + b.h, a.node) AS rn
        FROM (SELECT root, node, min(hops) AS h FROM {recursive_above} WHERE node <> root GROUP BY ALL) a JOIN (SELECT root, node, min(hops) AS h FROM {recursive_below} WHERE node <> root GROUP BY ALL) b ON a.node = b.node WHERE b.root <> a.root AND b.root <> a.node""",
    "proxies": f"""SELECT 'proxy_candidate' AS finding_type, model_urn, model_name, is_live, feature_urn, feature_name, source AS resource_urn, protected, ancestor, marker_urn, up_hops, down_hops,
        'Proxy candidate: ' || {field('source')} || ' shares ' || {field('ancestor')} || ' with ' || list_last(string_split(marker_urn, ':')) || ' column ' || {field('protected')} AS title, 'medium' AS severity
        FROM (SELECT l.*, f.name AS model_name, f.is_live, k.protected, k.ancestor, k.up_hops, k.down_hops, p.marker_urn, row_number() OVER (PARTITION BY l.model_urn, source, protected ORDER BY l.pos, l.feature_urn) AS first FROM {{linked}} l JOIN {{forks}} k ON k.root = l.source AND k.rn = 1 JOIN {{protected_marks}} p ON p.column_urn = k.protected JOIN {{refs}} f ON f.model_urn = l.model_urn) x WHERE first = 1""",
    "drifts": f"""SELECT 'input_schema_drift' AS finding_type, c.model_urn, f.name AS model_name, f.is_live, run_urn, dataset_urn AS resource_urn, count(CASE WHEN kind = 'added' THEN 1 END) AS added, count(CASE WHEN kind = 'removed' THEN 1 END) AS removed, count(CASE WHEN kind = 'retyped' THEN 1 END) AS retyped,
        string_agg(CASE kind WHEN 'added' THEN field_path || ' (added, ' || now || ')' WHEN 'removed' THEN field_path || ' (removed, was ' || trained || ')' ELSE field_path || ': ' || trained || ' -> ' || now END, ', ' ORDER BY field_path) AS drifted_fields,
        'Training-serving schema drift in ' || {dsname('dataset_urn')} || ' for ' || f.name AS title, CASE WHEN f.is_live THEN 'high' ELSE 'medium' END AS severity FROM {{changes}} c JOIN {{refs}} f ON f.model_urn = c.model_urn GROUP BY c.model_urn, f.name, f.is_live, run_urn, dataset_urn""",
    "deprecated": f"SELECT 'deprecated_input' AS finding_type, i.model_urn, f.name AS model_name, f.is_live, i.dataset_urn AS resource_urn, nullif(d.note, '') AS note, d.decommission_time_ms, 'Deprecated training input ' || {dsname('i.dataset_urn')} || ' for ' || f.name AS title, CASE WHEN f.is_live THEN 'medium' ELSE 'low' END AS severity FROM {{inputs}} i JOIN {{deprecations}} d ON d.entity_urn = i.dataset_urn AND d.deprecated JOIN {{refs}} f ON f.model_urn = i.model_urn",
    "table_risks": f"SELECT 'table_level_risk' AS finding_type, t.model_urn, f.name AS model_name, f.is_live, t.dataset_urn AS resource_urn, r.risk, r.detail, 0.25::DOUBLE AS mode_precision, 'Table-level ' || r.risk || ' input ' || {dsname('t.dataset_urn')} || ' for ' || f.name || ' (no column link)' AS title, CASE WHEN f.is_live THEN 'medium' ELSE 'low' END AS severity FROM {{tables_of}} t JOIN {{risks}} r ON r.dataset_urn = t.dataset_urn JOIN {{refs}} f ON f.model_urn = t.model_urn WHERE t.model_urn NOT IN (SELECT model_urn FROM {{linked}})",
    "radii": f"""SELECT 'upstream_freshness' AS finding_type, s.dataset_urn AS resource_urn, s.last_updated_ms, s.lag_hours, {SLA}::DOUBLE AS sla_hours, coalesce(k.nd, 0) AS n_datasets, coalesce(k.nf, 0) AS n_features, coalesce(m.n, 0)::INT AS n_models, coalesce(m.nl, 0) AS n_live_models, coalesce(m.models, '') AS models,
        CASE coalesce(m.worst, 2) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity, 'Stale upstream data in ' || {dsname('s.dataset_urn')} AS title FROM {{stale}} s
        LEFT JOIN (SELECT root, count(CASE WHEN kind = 'dataset' THEN 1 END) AS nd, count(CASE WHEN kind = 'mlFeature' THEN 1 END) AS nf FROM {{reached}} GROUP BY root) k ON k.root = s.dataset_urn
        LEFT JOIN (SELECT root, count(*) AS n, count(CASE WHEN is_live THEN 1 END) AS nl, min(severity_rank) AS worst, string_agg(model_urn, ' ' ORDER BY severity_rank, -n_live, -features_at_risk, has_owner, model_urn) AS models FROM {{radius}} GROUP BY root) m ON m.root = s.dataset_urn""",
}
