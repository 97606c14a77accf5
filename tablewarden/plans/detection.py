"""Queries of joins and graph walks (J items) and what findings say (P items)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, urn
from ..operators import tables, walk
from .audit import Audit
from .fixture import AGE, GENDER, LABEL, PII, SECRET, oracle
from .oracle_parts import PARTS, PATH_TEXT, best_sql, reach_sql
from .scalars import FIELD_RE

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(_audit(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql, PARTS | (extra or {}))
        return f

    return add


def _audit(spark, sf_dir: str) -> Audit:
    from .scoring import audit_of  # scoring builds on this module

    return audit_of(spark, sf_dir)


def flat(df, *paths):
    """Arrays as joined strings, for the oracle's comparison."""
    for p in paths:
        df = df.withColumn(p, F.array_join(p, " "))
    return df


query("j1_model_ref", "SELECT * FROM {refs}")(lambda a: a.refs)
query("j2_column_marker", "SELECT 'class' AS marks, * FROM {class_marks} UNION ALL SELECT 'label', * FROM {label_marks}")(
    lambda a: a.marks(PII, SECRET, AGE, GENDER).select(F.lit("class").alias("marks"), "*").unionByName(a.marks(LABEL).select(F.lit("label").alias("marks"), "*"))
)


@query("j3_marked_ancestor", f"SELECT m.root, array_to_string(m.path, ' ') AS path, m.ancestor, m.marker_urn, coalesce(c.truncated, false) AS truncated, coalesce(c.hop_capped, false) AS hop_capped FROM {{class_matches}} m LEFT JOIN (SELECT root, count(*) >= 500 AS truncated, max(hops) > 6 AS hop_capped FROM {{cone}} WHERE node <> root GROUP BY root) c ON c.root = m.root")
def _(a):
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return flat(a.class_matches.join(a.limits, "root", "left").select("root", "path", "ancestor", "marker_urn", no("truncated"), no("hop_capped")), "path")


@query("j4_best_match", f"SELECT root, array_to_string(path, ' ') AS path, ancestor, marker_urn, n_matches FROM ({best_sql('class_matches')}) x WHERE rn = 1")
def _(a):
    return flat(walk.best_match(a.class_matches).select("root", "path", "ancestor", "marker_urn", "n_matches"), "path")


CHAINS = {
    "recursive_chains": "SELECT source AS root, [source] AS path, source AS node FROM {sources} UNION ALL SELECT w.root, list_append(w.path, e.dst), e.dst FROM {recursive_chains} w JOIN {up_edges} e ON e.src = w.node WHERE len(w.path) <= 3 AND NOT list_contains(w.path, e.dst)",
}


@query("j5_derivation_chains", "SELECT root, array_to_string(path, ' ') AS path, len(path)::INT AS n FROM {recursive_chains} WHERE len(path) >= 2", CHAINS)
def _(a):
    up = a.t.column_lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst")).distinct()
    starts = a.sources.select(F.col("column_urn").alias("root"), F.col("column_urn").alias("node"))
    return flat(walk.chains(starts, up, 3).where("size(path) >= 2").select("root", "path", F.size("path").alias("n")), "path")


RELATED = {"related_starts": "SELECT column_urn AS root, column_urn AS node FROM {class_marks}", "recursive_rup": reach_sql("recursive_rup", "related_starts", "up_edges", 3), "recursive_rdown": reach_sql("recursive_rdown", "related_starts", "down_edges", 3)}


@query("j6_related_columns", "SELECT 'up' AS direction, root, node, min(hops)::INT AS hops FROM {recursive_rup} WHERE node <> root GROUP BY ALL UNION ALL SELECT 'down', root, node, min(hops)::INT FROM {recursive_rdown} WHERE node <> root GROUP BY ALL", RELATED)
def _(a):
    up = a.t.column_lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst"))
    starts = a.marks(PII, SECRET, AGE, GENDER).select(F.col("column_urn").alias("root"), F.col("column_urn").alias("node"))
    ways = [walk.reach(starts, e, 3).where("hops > 0").withColumn("direction", F.lit(d)) for d, e in (("up", up), ("down", up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))]
    return ways[0].unionByName(ways[1])


KEPT = ["finding_type", "model_urn", "model_name", "is_live", "feature_urn", "resource_urn", "ancestor", "marker_urn", "path_text", "title", "severity"]
KEPT_SQL = ", ".join(KEPT)
query("j7_target_leakage", f"SELECT {KEPT_SQL} FROM {{leaks}}")(lambda a: a.leaks.select(*KEPT))
query("j8_sensitive_source", f"SELECT {KEPT_SQL} FROM {{exposures}}")(lambda a: a.exposures.select(*KEPT))
query("j9_proxy_candidates", "SELECT * EXCLUDE (up_hops, down_hops), up_hops::INT AS up_hops, down_hops::INT AS down_hops FROM {proxies}")(lambda a: a.proxies)
query("j10_schema_drift", "SELECT * FROM {drifts}")(lambda a: a.drifts)
query("j11_drift_candidates", "SELECT DISTINCT model_urn, dataset_urn FROM {drift_base}")(
    lambda a: a.t.model_runs.join(a.t.run_inputs.select("run_urn", "dataset_urn").join(a.t.training_snapshots.select("run_urn", "dataset_urn"), ["run_urn", "dataset_urn"]), "run_urn").select("model_urn", "dataset_urn").distinct()
)
query("j12_model_input_datasets", "SELECT * FROM {inputs}")(lambda a: a.inputs)
query("j13_deprecated_input", "SELECT * FROM {deprecated}")(lambda a: a.deprecated)
query("j14_downstream_reach", "SELECT root, node, hops::INT AS hops, kind FROM {reached}")(lambda a: a.reached.select("root", "node", "hops", "kind"))
query("j15_blast_radius", "SELECT * FROM {radii}")(lambda a: flat(a.radii, "models"))

UPSTREAM = {"ds_starts": "SELECT dataset_urn AS root, dataset_urn AS node FROM {datasets}", "ds_up": "SELECT downstream_urn AS src, upstream_urn AS dst FROM {table_lineage}", "recursive_dsup": reach_sql("recursive_dsup", "ds_starts", "ds_up", 3)}
query("j16_upstream_datasets", "SELECT root, node, min(hops)::INT AS hops FROM {recursive_dsup} WHERE node <> root GROUP BY ALL", UPSTREAM)(lambda a: tables.upstream_datasets(a.t.datasets, a.t.table_lineage, 3))
query("j17_training_tables", "SELECT * FROM {tables_of}")(lambda a: a.training_tables)
query("j18_table_level_risk", "SELECT * FROM {table_risks}")(lambda a: a.table_risks)

COARSE = {
    "coarse_starts": "SELECT DISTINCT source_dataset_urn AS root, source_dataset_urn AS node FROM {features}",
    "recursive_coarse": reach_sql("recursive_coarse", "coarse_starts", "ds_up", 6),
    "label_tables": f"SELECT DISTINCT regexp_extract(column_urn, '{FIELD_RE}', 1) AS node FROM {{label_marks}}",
    "coarse": "SELECT feature_urn FROM {features} WHERE source_dataset_urn IN (SELECT root FROM {recursive_coarse} WHERE node IN (SELECT node FROM {label_tables}))",
} | {"ds_up": UPSTREAM["ds_up"]}


def coarse(a):
    return tables.table_level_leakage(a.t.features, a.t.table_lineage, a.marks(LABEL), 6)


query("j19_table_level_leakage", "SELECT * FROM {coarse}", COARSE)(coarse)

query("p7_diff_label", "SELECT model_urn, run_urn, dataset_urn, field_path, CASE kind WHEN 'added' THEN field_path || ' (added, ' || now || ')' WHEN 'removed' THEN field_path || ' (removed, was ' || trained || ')' ELSE field_path || ': ' || trained || ' -> ' || now END AS label FROM {changes}")(
    lambda a: a.changes.select("model_urn", "run_urn", "dataset_urn", "field_path", text.diff_label("field_path", "trained", "now").alias("label"))
)
query("p8_path_text", f"SELECT root, array_to_string(path, ' ') AS path, {PATH_TEXT} AS path_text FROM {{class_matches}}")(lambda a: flat(a.class_matches.select("root", "path", text.path_text(F.transform("path", urn.field_path)).alias("path_text")), "path"))
query("p25_live_models_filter", "SELECT root, model_urn FROM {radius} WHERE n_live > 0")(lambda a: a.radius.where("n_live > 0").select("root", "model_urn"))
query("w4_nearest_ancestor", "SELECT root, protected, ancestor, up_hops::INT AS up_hops, down_hops::INT AS down_hops FROM {forks} WHERE rn = 1 AND root IN (SELECT source FROM {linked})")(
    lambda a: a.proxies.select(F.col("resource_urn").alias("root"), "protected", "ancestor", "up_hops", "down_hops").distinct()
)
query("w5_best_path", "SELECT model_urn, feature_urn, path_text FROM {leaks}")(lambda a: a.leaks.select("model_urn", "feature_urn", "path_text"))
query("u1_classification_union", "SELECT DISTINCT column_urn FROM (SELECT column_urn FROM {sensitive_marks} UNION SELECT column_urn FROM {protected_marks}) x")(
    lambda a: a.marks(PII, SECRET).select("column_urn").union(a.marks(AGE, GENDER).select("column_urn")).distinct()
)
query("u2_features_at_risk", "SELECT root, model_urn, n AS features_at_risk FROM {risk}")(
    lambda a: a.reached.where("kind = 'mlFeature'").join(a.t.model_features, F.col("node") == F.col("feature_urn")).groupBy("root", "model_urn").agg(F.count_distinct("feature_urn").alias("features_at_risk"))
)
query("u5_schema_diff_union", "SELECT run_urn, dataset_urn, count(DISTINCT field_path) AS n_fields FROM (SELECT run_urn, dataset_urn, field_path FROM {training_schema} UNION SELECT s.run_urn, s.dataset_urn, f.field_path FROM {training_snapshots} s JOIN {schema_fields} f ON f.dataset_urn = s.dataset_urn) x GROUP BY ALL")(
    lambda a: a.t.training_schema.select("run_urn", "dataset_urn", "field_path").union(a.t.training_snapshots.join(a.t.schema_fields, "dataset_urn").select("run_urn", "dataset_urn", "field_path")).groupBy("run_urn", "dataset_urn").agg(F.count_distinct("field_path").alias("n_fields"))
)
query("t2_models_worst_first", "SELECT root, model_urn, row_number() OVER (PARTITION BY root ORDER BY severity_rank, -n_live, -features_at_risk, has_owner, model_urn)::INT AS place FROM {radius}")(
    lambda a: a.radius.select("root", "model_urn", F.row_number().over(Window.partitionBy("root").orderBy(*tables.models_worst_first())).alias("place"))
)


@query("t6_lineage_result_cap", "SELECT root, node, rank::INT AS rank, truncated FROM (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY hops, node) AS rank, count(*) OVER (PARTITION BY root) >= 10 AS truncated FROM {reached}) x WHERE rank <= 10")
def _(a):
    starts = a.stale.select(F.col("dataset_urn").alias("root"), F.col("dataset_urn").alias("node"))
    return walk.capped(starts, a.edges, a.hops, 10).select("root", "node", "rank", "truncated")


RADIUS_WARNINGS = f"SELECT r.resource_urn, CASE WHEN r.n_models = 0 AND coalesce(c.full_cone, false) THEN 'unknown' WHEN r.n_models = 0 THEN 'none within 3 hops' WHEN coalesce(c.full_cone, false) THEN 'more may be affected' END AS warning FROM {{radii}} r LEFT JOIN (SELECT root, count(*) >= 20 AS full_cone FROM {{reached}} GROUP BY root) c ON c.root = r.resource_urn"


@query("p28_radius_warnings", RADIUS_WARNINGS)
def _(a):
    from ..operators.findings import radius_warnings

    return radius_warnings(a.radii, a.reached, 20, 3)


