"""Queries of lifecycles, links, histories, quality, streaming and the example data (remaining items)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urn
from ..operators import etl, history, linking, quality, tables, upkeep, walk
from ..sources import log
from .fixture import LABEL, NOW_MS, oracle
from .oracle_parts import dsname
from .scalars import FIELD_RE
from .scoring import ALL, Scored, audit_of

QUERIES, SQL = {}, {}
IDLE = f"greatest({NOW_MS} - greatest(created_ms, last_modified_ms, date_ms), 0) / 86400000.0::DOUBLE"
EXTRA = {
    "usage": f"SELECT m.model_urn, CASE WHEN greatest(created_ms, last_modified_ms, date_ms) IS NOT NULL THEN {IDLE} END AS idle_days, NOT r.is_live AND coalesce(CASE WHEN greatest(created_ms, last_modified_ms, date_ms) IS NOT NULL THEN {IDLE} END > 90, false) AS unused, greatest(created_ms, last_modified_ms, date_ms) IS NULL AS undated FROM {{models}} m JOIN {{refs}} r ON r.model_urn = m.model_urn",
    "ds_starts": "SELECT DISTINCT dataset_urn AS root, dataset_urn AS node FROM {inputs}",
    "ds_up": "SELECT downstream_urn AS src, upstream_urn AS dst FROM {table_lineage}",
    "recursive_dsup": "SELECT root, node, 0 AS hops FROM {ds_starts} UNION SELECT w.root, e.dst, w.hops + 1 FROM {recursive_dsup} w JOIN {ds_up} e ON e.src = w.node WHERE w.hops < 3",
    "feeding": "SELECT DISTINCT i.model_urn, u.node AS dataset_urn FROM {inputs} i JOIN {recursive_dsup} u ON u.root = i.dataset_urn",
    "resources": "SELECT model_urn, dataset_urn AS resource_urn FROM {feeding} UNION SELECT model_urn, dataset_urn FROM {drift_base} UNION SELECT model_urn, source FROM {linked}",
    "ours": "SELECT *, regexp_extract(description, '(?:^|\\s)tablewarden-run=(\\S+)\\s*$', 1) AS run_id, CASE WHEN title LIKE 'Stale upstream data in %' THEN 'upstream_freshness' WHEN title LIKE 'Training-serving schema drift in %' THEN 'input_schema_drift' WHEN title LIKE 'Deprecated training input %' THEN 'deprecated_input' END AS finding_type FROM {incidents}",
    "lives": "SELECT incident_urn, finding_type, created_ms, CASE WHEN state = 'RESOLVED' THEN updated_ms END AS resolved_ms, run_id FROM {ours} WHERE run_id <> '' AND finding_type IS NOT NULL AND resource_urn IN (SELECT resource_urn FROM {resources})",
    "polls": "SELECT user_id AS target, event_id AS seq, CASE WHEN event_id % 5 < 3 THEN 'a' WHEN event_id % 7 = 0 THEN NULL ELSE 'b' END AS sig FROM {events}",
    "entries": "SELECT 'm' || user_id AS model_urn, event_id AS recorded_at, 'r' || (event_id % 400) AS run_id, (event_id % 101)::INT AS score, CASE WHEN event_id % 50 < 25 THEN 'v1' ELSE 'v2' END AS version FROM {events}",
    "once": "SELECT * FROM {entries} QUALIFY row_number() OVER (PARTITION BY model_urn, run_id ORDER BY recorded_at DESC) = 1",
    "decoded": "SELECT *, CASE WHEN json_valid(aspect_json) THEN json_extract_string(aspect_json, '$.mlFeatures') END AS feats FROM {aspect_log} WHERE entity_urn IS NOT NULL AND aspect_name IS NOT NULL",
}
EVERY = ALL | EXTRA


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(audit_of(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql, EVERY)
        return f

    return add


def usage(a: Scored):
    return upkeep.model_usage(a.t.models, a.refs, NOW_MS, 90.0)


def above(a: Scored):
    return tables.upstream_datasets(a.inputs.select("dataset_urn").distinct(), a.t.table_lineage, 3)


def feeding(a: Scored):
    return upkeep.feeding_datasets(a.inputs, above(a))


def resources(a: Scored):
    seen = a.t.model_runs.join(a.t.run_inputs.select("run_urn", "dataset_urn").join(a.t.training_snapshots.select("run_urn", "dataset_urn"), ["run_urn", "dataset_urn"]), "run_urn").select("model_urn", "dataset_urn")
    return upkeep.model_resources(a.inputs, seen, a.linked, above(a))


query("j20_feeding_datasets", "SELECT * FROM {feeding}")(feeding)
query("j21_unused_models", "SELECT * FROM {usage}")(usage)
query("j22_orphaned_inputs", "SELECT dataset_urn, string_agg(f.model_urn, ' ' ORDER BY f.model_urn) AS models FROM {feeding} f JOIN {usage} u ON u.model_urn = f.model_urn GROUP BY dataset_urn HAVING bool_and(unused)")(lambda a: upkeep.orphaned_inputs(feeding(a), usage(a)).withColumn("models", F.array_join("models", " ")))
query("j23_model_resources", "SELECT * FROM {resources}")(resources)
query("j24_read_lifecycles", "SELECT * FROM {lives} ORDER BY created_ms, incident_urn")(lambda a: upkeep.read_lifecycles(a.t.incidents, resources(a)).orderBy("created_ms", "incident_urn"))
query("a8_mttr_by_type", "SELECT k.finding_type, count(l.incident_urn) AS raised, count(CASE WHEN l.incident_urn IS NOT NULL AND resolved_ms IS NULL THEN 1 END) AS open, count(h) AS resolved, avg(h) AS mean_hours, median(h) AS median_hours FROM (VALUES ('upstream_freshness'), ('target_leakage'), ('input_schema_drift'), ('sensitive_source'), ('proxy_candidate'), ('deprecated_input'), ('table_level_risk')) AS k(finding_type) LEFT JOIN (SELECT *, CASE WHEN resolved_ms >= created_ms THEN (resolved_ms - created_ms) / 3600000.0::DOUBLE END AS h FROM {lives}) l ON l.finding_type = k.finding_type GROUP BY ALL")(
    lambda a: upkeep.mttr_by_type(upkeep.read_lifecycles(a.t.incidents, resources(a)))
)
query("j25_new_incidents", "SELECT DISTINCT resource_urn, incident_type, title FROM {findings} f WHERE NOT EXISTS (SELECT 1 FROM {incidents} i WHERE i.state = 'ACTIVE' AND i.resource_urn = f.resource_urn AND i.type = f.incident_type AND i.title = f.title) AND (resource_urn IN (SELECT dataset_urn FROM {datasets}) OR resource_urn IN (SELECT column_urn FROM {schema_fields}))")(
    lambda a: upkeep.new_incidents(a.findings, a.t.incidents, a.t.datasets, a.t.schema_fields)
)
SQL_J28 = f"SELECT dataset_urn, column_urn, CASE r WHEN 1 THEN 'marked' WHEN 2 THEN 'derived from label' ELSE 'name' END AS reason FROM (SELECT s.*, CASE WHEN column_urn IN (SELECT column_urn FROM {{label_marks}}) THEN 1 WHEN column_urn IN (SELECT root FROM {{label_matches}}) THEN 2 WHEN field_path = 'churned' THEN 3 END AS r FROM {{schema_fields}} s) x WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset_urn ORDER BY r, ordinal) = 1"


def labels_inferred(a: Scored):
    return linking.infer_label_column(a.t.schema_fields, a.marks(LABEL), a.label_matches, ["churned", "label", "target"])


query("j28_infer_label_column", SQL_J28)(labels_inferred)
query("j40_infer_excluded_columns", f"SELECT dataset_urn, column_urn FROM {{schema_fields}} WHERE is_primary_key OR is_part_of_key OR is_partitioning_key UNION SELECT dataset_urn, column_urn FROM ({SQL_J28}) l")(lambda a: linking.infer_excluded(a.t.schema_fields, labels_inferred(a)))


def complete_links(a: Scored):
    found = linking.recorded_links(a.t.entity_properties)
    return found.select("model_urn", F.col("feature_table").alias("dataset_urn"), "label_column", "excluded")


def excluded_of(a: Scored):
    return complete_links(a).select("model_urn", F.explode(F.split("excluded", ",")).alias("field_path"))


COMPLETE = "(SELECT model_urn, feature_dataset_urn AS dataset_urn, label_column_urn, exclude FROM {recorded_links} WHERE feature_dataset_urn IS NOT NULL AND label_column_urn IS NOT NULL)"
query("j29_link_features", f"SELECT l.model_urn, 'urn:li:mlFeature:(' || {dsname('l.dataset_urn')} || ',' || s.field_path || ')' AS feature_urn, s.column_urn FROM {COMPLETE} l JOIN {{schema_fields}} s ON s.dataset_urn = l.dataset_urn WHERE NOT list_contains(string_split(l.exclude, ','), s.field_path)")(
    lambda a: linking.link_features(complete_links(a), a.t.schema_fields, excluded_of(a))
)
query("j30_label_lineage", "SELECT DISTINCT root, node FROM (SELECT column_urn AS root, column_urn AS node FROM {label_marks} UNION ALL SELECT x.root, x.node FROM (WITH RECURSIVE w AS (SELECT column_urn AS root, column_urn AS node, 0 AS h FROM {label_marks} UNION SELECT w.root, e.dst, h + 1 FROM w JOIN {up_edges} e ON e.src = w.node WHERE h < 6) SELECT root, node FROM w) x) y")(
    lambda a: walk.reach(a.marks(LABEL).select(F.col("column_urn").alias("root"), F.col("column_urn").alias("node")), a.t.column_lineage.select(F.col("downstream_column_urn").alias("src"), F.col("upstream_column_urn").alias("dst")), 6).select("root", "node")
)
DECL = "SELECT name AS \"table\", 'f' || i AS \"column\" FROM {datasets} CROSS JOIN (VALUES (3), (4), (7)) AS v(i)"
query("j31_declared_link_check", f"""SELECT coalesce(d."table", t."table") AS "table", coalesce(d."column", t."column") AS "column", CASE WHEN d."table" IS NULL THEN 'excluded' ELSE 'missing' END AS problem FROM ({DECL}) d FULL JOIN (SELECT d.name AS "table", field_path AS "column" FROM {{schema_fields}} s JOIN {{datasets}} d ON d.dataset_urn = s.dataset_urn) t ON d."table" = t."table" AND d."column" = t."column" WHERE d."table" IS NULL OR t."table" IS NULL""")(
    lambda a: linking.declared_check(a.t.datasets.select(F.col("name").alias("table"), F.explode(F.array(*[F.lit(f"f{i}") for i in (3, 4, 7)])).alias("column")), a.t.schema_fields.select(urn.dataset_name("dataset_urn").alias("table"), F.col("field_path").alias("column")))
)
query("u3_excluded_missing", "SELECT dataset_urn, count(*) AS n_excluded FROM {schema_fields} WHERE field_path NOT IN ('f3', 'f4') GROUP BY ALL")(lambda a: a.t.schema_fields.select("dataset_urn", "field_path").exceptAll(a.t.schema_fields.where("field_path in ('f3', 'f4')").select("dataset_urn", "field_path")).groupBy("dataset_urn").agg(F.count(F.lit(1)).alias("n_excluded")))
query("u6_merged_features", f"SELECT model_urn, count(DISTINCT f)::INT AS n FROM (SELECT model_urn, feature_urn AS f FROM {{model_features}} UNION SELECT l.model_urn, 'urn:li:mlFeature:(' || {dsname('l.dataset_urn')} || ',' || s.field_path || ')' FROM {COMPLETE} l JOIN {{schema_fields}} s ON s.dataset_urn = l.dataset_urn WHERE NOT list_contains(string_split(l.exclude, ','), s.field_path)) x GROUP BY ALL")(
    lambda a: a.t.model_features.select("model_urn", "feature_urn").union(linking.link_features(complete_links(a), a.t.schema_fields, excluded_of(a)).select("model_urn", "feature_urn")).groupBy("model_urn").agg(F.size(F.array_sort(F.collect_set("feature_urn"))).alias("n"))
)
query("j37_models_with_recorded_link", "SELECT model_urn, feature_dataset_urn AS feature_table, label_column_urn AS label_column, exclude AS excluded FROM {recorded_links} WHERE feature_dataset_urn IS NOT NULL AND label_column_urn IS NOT NULL")(lambda a: linking.recorded_links(a.t.entity_properties))
query("j38_capture_training_schema", f"SELECT t.run_urn, t.dataset_urn, t.field_path, t.native_type FROM {{training_schema}} t WHERE (t.run_urn, t.dataset_urn) NOT IN (SELECT (r.run_urn, l.dataset_urn) FROM {COMPLETE} l JOIN {{model_runs}} r ON r.model_urn = l.model_urn) UNION ALL SELECT k.run_urn, k.dataset_urn, s.field_path, s.native_type FROM (SELECT DISTINCT r.run_urn, l.dataset_urn FROM {COMPLETE} l JOIN {{model_runs}} r ON r.model_urn = l.model_urn) k JOIN {{schema_fields}} s ON s.dataset_urn = k.dataset_urn")(
    lambda a: linking.capture_schema(complete_links(a), a.t.model_runs, a.t.schema_fields, a.t.training_schema)
)
query("j39_declarations_agree", "SELECT name AS model, 2::BIGINT AS sources, k % 3 = 0 AS agree FROM {datasets}")(
    lambda a: linking.declarations_agree(a.t.datasets.select(F.col("name").alias("model"), F.explode(F.expr("array(named_struct('s', 'dbt', 'c', 'a'), named_struct('s', 'registry', 'c', if(k % 3 = 0, 'a', 'b')))")).alias("x")).select("model", F.col("x.s").alias("source"), F.col("x.c").alias("column")))
)
ISSUES = "SELECT owner_urn, o.entity_urn, issue, rank::INT AS rank FROM (SELECT * FROM {owners} QUALIFY row_number() OVER (PARTITION BY owner_urn ORDER BY entity_urn) <= 200) o JOIN (SELECT resource_urn AS entity_urn, 'incident' AS issue, 0 AS rank FROM {incidents} WHERE state = 'ACTIVE' UNION SELECT assertee_urn, 'failing assertion', 1 FROM (SELECT assertion_urn, assertee_urn, arg_max(result_type, ts_ms) AS r FROM {assertion_runs} GROUP BY ALL) x WHERE r = 'FAILURE' UNION SELECT entity_urn, 'deprecated', 2 FROM {deprecations} WHERE deprecated) i ON i.entity_urn = o.entity_urn"
query("j32_owned_issues", ISSUES)(lambda a: upkeep.owned_issues(a.t.owners, a.t.incidents, log.latest_assertion_result(a.t.assertion_runs), a.t.deprecations, 200))


query("s9_upsert_table", "SELECT model_urn, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey ELSE coalesce(name, '') END AS name, version, c_custkey % 3 = 0 AS changed FROM {models}")(
    lambda a: upkeep.upsert(a.t.models.select("model_urn", F.coalesce("name", F.lit("")).alias("name"), "version"), a.t.models.where("c_custkey % 3 = 0").select("model_urn", F.expr("'n' || c_custkey").alias("name")), ["model_urn"])
)
CONTRACT = "CASE WHEN native_type LIKE '%CHAR%' THEN 'string' WHEN native_type LIKE '%BOOL%' THEN 'boolean' WHEN native_type LIKE '%TIMESTAMP%' THEN 'timestamp' ELSE 'number' END"
query("s11_schema_contract_rows", f"SELECT i.model_urn, i.dataset_urn, s.field_path, s.native_type AS physical_type, {CONTRACT} AS logical_type, NOT s.nullable AS required FROM {{inputs}} i JOIN {{schema_fields}} s ON s.dataset_urn = i.dataset_urn")(lambda a: linking.contract_rows(a.inputs, a.t.schema_fields))
query("s12_guarding_assertions", "SELECT 'freshness-' || left(sha256(dataset_urn), 12) AS assertion_id, dataset_urn, 6.0::DOUBLE AS sla_hours, 'FAILURE' AS result, lag_hours FROM {stale}")(lambda a: upkeep.guarding_assertions(a.stale, 6.0))
query("a9_confusion_matrix", "SELECT tp, fp, tn, fn, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall FROM (SELECT count(CASE WHEN quality = 0 AND n_chars < 200 THEN 1 END) AS tp, count(CASE WHEN quality = 1 AND n_chars < 200 THEN 1 END) AS fp, count(CASE WHEN quality = 1 AND n_chars >= 200 THEN 1 END) AS tn, count(CASE WHEN quality = 0 AND n_chars >= 200 THEN 1 END) AS fn FROM {labels} JOIN {documents} USING (doc_id)) x")(
    lambda a: quality.confusion(a.t.labels.join(a.t.documents, "doc_id").select((F.col("quality") == 0).alias("expected"), (F.col("n_chars") < 200).alias("observed"))).drop("f1", "false_positive_rate")
)
query("a10_latency_summary", "SELECT event_type, count(value) AS n, median(value) AS median, max(value) AS worst FROM {events} GROUP BY ALL")(lambda a: quality.latency(a.t.events, "value", "event_type"))
query("a11_target_verdict", "SELECT event_id, CASE WHEN v IS NULL THEN 'not measured' WHEN v >= 0.5 THEN 'meets' ELSE 'misses' END AS verdict FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (event_id % 10) / 10.0::DOUBLE END AS v FROM {events}) x")(
    lambda a: a.t.events.select("event_id", F.expr("if(event_id % 9 <> 0, (event_id % 10) / 10.0D, null)").alias("v")).select("event_id", quality.verdict("v", 0.5).alias("verdict"))
)
query("a21_scan_run_record", "SELECT 'r' || (seq % 300) AS run_id, count(DISTINCT CASE split_part(entity_urn, ':', 3) WHEN 'schemaField' THEN regexp_extract(entity_urn, '" + FIELD_RE + "', 1) ELSE entity_urn END) AS inputs, CASE WHEN bool_or(seq % 50 = 7) THEN 'FAILURE' ELSE 'SUCCESS' END AS status, max(seq) - min(seq) AS duration_ms FROM {aspect_log} GROUP BY 1")(
    lambda a: upkeep.scan_runs(a.t.aspect_log.select(F.expr("'r' || (seq % 300)").alias("run_id"), "entity_urn", F.expr("seq % 50 = 7").alias("failed"), F.col("seq").alias("ts_ms")))
)
query("a23_trial_summary", "SELECT event_type AS family, count(CASE WHEN event_id % 10 <> 0 THEN 1 END) AS trials, count(CASE WHEN event_id % 10 = 0 THEN 1 END) AS unsettled, count(CASE WHEN event_id % 10 <> 0 AND event_id % 4 = 0 THEN 1 END) AS boundaries, count(CASE WHEN event_id % 10 <> 0 AND event_id % 3 = 0 AND event_id % 7 <> 0 THEN 1 END) AS tp, count(CASE WHEN event_id % 10 <> 0 AND event_id % 3 <> 0 AND event_id % 7 <> 0 THEN 1 END) AS fp, true AS could_fail FROM {events} GROUP BY ALL")(
    lambda a: quality.trial_summary(a.t.events.selectExpr("event_type AS family", "event_id % 10 <> 0 AS settled", "event_id % 4 = 0 AS boundary", "event_id % 3 = 0 AS expected", "event_id % 7 <> 0 AS observed"))
)
query("a24_rerun_duplicates", "SELECT resource_urn, count(CASE WHEN state = 'RESOLVED' THEN 1 END) AS before, count(*) AS after, count(CASE WHEN state <> 'RESOLVED' THEN 1 END) AS duplicates FROM {incidents} GROUP BY ALL")(lambda a: quality.rerun_duplicates(a.t.incidents.where("state = 'RESOLVED'"), a.t.incidents))
ENTRIES = ["'m' || user_id AS model_urn", "event_id AS recorded_at", "'r' || (event_id % 400) AS run_id", "cast(event_id % 101 AS int) AS score", "if(event_id % 50 < 25, 'v1', 'v2') AS version"]
query("w1_capped_history", "SELECT model_urn, run_id, recorded_at, score, version, row_number() OVER (PARTITION BY model_urn ORDER BY recorded_at DESC, run_id DESC)::INT AS age FROM {once} QUALIFY row_number() OVER (PARTITION BY model_urn ORDER BY recorded_at DESC, run_id DESC) <= 20")(lambda a: history.capped_history(a.t.events.selectExpr(*ENTRIES)))
query("w2_previous_score", "SELECT model_urn, recorded_at, lag(score) OVER (PARTITION BY model_urn ORDER BY recorded_at, run_id) AS previous_score FROM {entries}")(lambda a: history.with_previous(a.t.events.selectExpr(*ENTRIES)).select("model_urn", "recorded_at", "previous_score"))
query("w3_score_trend", "SELECT model_urn, recorded_at, coalesce(lag(version) OVER (PARTITION BY model_urn ORDER BY recorded_at, run_id) <> version, false) AS trend_break FROM {entries}")(lambda a: history.with_previous(a.t.events.selectExpr(*ENTRIES)).select("model_urn", "recorded_at", "trend_break"))
ISLANDS = "SELECT target, seq, row_number() OVER (PARTITION BY target, g ORDER BY seq)::INT AS streak FROM (SELECT *, sum(c) OVER (PARTITION BY target ORDER BY seq) AS g FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(sig) OVER w IS NOT DISTINCT FROM sig THEN 0 ELSE 1 END AS c FROM {polls} WINDOW w AS (PARTITION BY target ORDER BY seq)) x) y"
POLLS = ["user_id AS target", "event_id AS seq", "CASE WHEN event_id % 5 < 3 THEN 'a' WHEN event_id % 7 = 0 THEN NULL ELSE 'b' END AS sig"]
query("w6_unchanged_polls", f"SELECT target, seq, streak - 1 AS unchanged, streak - 1 >= 4 AS asleep FROM ({ISLANDS}) z")(lambda a: history.streaks(a.t.events.selectExpr(*POLLS), "sig", order="seq").select("target", "seq", (F.col("streak") - 1).alias("unchanged"), (F.col("streak") - 1 >= 4).alias("asleep")))
query("w7_failure_streak", f"SELECT z.target, z.seq, CASE WHEN p.sig IS NULL THEN streak ELSE 0 END AS failures FROM ({ISLANDS}) z JOIN {{polls}} p ON p.target = z.target AND p.seq = z.seq")(lambda a: history.streaks(a.t.events.selectExpr(*POLLS), "sig", order="seq").select("target", "seq", F.when(F.col("sig").isNull(), F.col("streak")).otherwise(0).alias("failures")))
RAW = ["c_custkey AS customer_id", "cast(c_custkey % 40 AS int) AS tenure", "c_acctbal AS monthly", "if(c_custkey % 6 = 0, '  ', string(c_custkey * 2)) AS total", "if(c_custkey % 2 = 0, 'monthly', 'yearly') AS contract", "if(c_custkey % 4 = 0, 'Yes', 'No') AS churn"]
STG = "SELECT c_custkey AS customer_id, nullif(c_custkey % 40, 0)::INT AS tenure_months, c_acctbal AS monthly_charges, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey * 2)::DOUBLE END AS total_charges, CASE WHEN c_custkey % 2 = 0 THEN 'monthly' ELSE 'yearly' END AS contract, CASE WHEN c_custkey % 4 = 0 THEN 'Yes' ELSE 'No' END AS churn FROM {customer}"
EVERY |= {"stg": STG, "feat": "SELECT customer_id, tenure_months, monthly_charges, total_charges, (contract = 'monthly')::INT AS is_monthly, (churn = 'No')::INT AS is_retained FROM {stg}"}
staged = lambda a: etl.stg_customers(a.t.customer.selectExpr(*RAW))
query("e1_stg_customers", "SELECT * FROM {stg}")(staged)
query("e2_customer_features", "SELECT * FROM {feat}")(lambda a: etl.customer_features(staged(a)))
query("e3_customer_labels", "SELECT customer_id, (churn = 'Yes')::INT AS churned FROM {stg}")(lambda a: etl.customer_labels(staged(a)))
query("e4_date_spine", "SELECT d::DATE AS date_day, (SELECT count(*) FROM {orders} o WHERE o.o_orderdate::DATE = d::DATE) AS n_orders FROM range(DATE '1995-01-01', DATE '2001-09-01', INTERVAL 1 DAY) AS t(d)")(
    lambda a: etl.date_spine(a.t.orders.sparkSession, "1995-01-01", "2001-09-01").join(a.t.orders.groupBy(F.to_date("o_orderdate").alias("date_day")).agg(F.count(F.lit(1)).alias("n_orders")), "date_day", "left").na.fill(0)
)
query("j35_training_set", "SELECT f.*, (s.churn = 'Yes')::INT AS churned FROM {feat} f JOIN {stg} s ON s.customer_id = f.customer_id WHERE f.tenure_months IS NOT NULL AND f.total_charges IS NOT NULL AND f.monthly_charges IS NOT NULL")(lambda a: etl.training_set(etl.customer_features(staged(a)), etl.customer_labels(staged(a))).drop("split"))
