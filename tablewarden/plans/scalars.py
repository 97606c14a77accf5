"""Queries of sources and scalar expressions (S and P items)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import rules, text, urn
from ..operators.steps import shared_dir
from ..sources import log
from .fixture import NOW_MS, Fixture, oracle

SLA = 48.0
DATASET_RE = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),(.+),([^,]+)\)$"
FIELD_RE = r"^urn:li:schemaField:\((urn:li:dataset:\(.*?\)),(.+)\)$"
NAME_SQL = r"coalesce(nullif(name, ''), regexp_extract(model_urn, '^urn:li:mlModel:\([^,]+,(.+),[^,]+\)$', 1))"
LATEST_OP = "SELECT dataset_urn, last_updated_ms, ts_ms FROM {operations} WHERE last_updated_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset_urn ORDER BY ts_ms DESC, last_updated_ms DESC) = 1"

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register f(Fixture) under a name, with its oracle."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql, extra)
        return f

    return add


@query("s1_aspect_snapshot", """SELECT entity_urn, aspect_name, change_type, aspect_json, seq FROM (SELECT *, row_number() OVER (PARTITION BY entity_urn, aspect_name ORDER BY seq DESC) AS rn FROM {aspect_log} WHERE entity_urn IS NOT NULL AND aspect_name IS NOT NULL AND change_type IN ('UPSERT', 'CREATE', 'RESTATE', 'DELETE')) x WHERE rn = 1 AND change_type <> 'DELETE'""")
def _(t):
    return log.aspect_snapshot(t.aspect_log)


@query("s2_decode_change_event", """SELECT seq, entity_type, entity_urn, aspect_name, change_type, CASE WHEN json_valid(aspect_json) THEN json_extract_string(aspect_json, '$.name') END AS name, CASE WHEN json_valid(aspect_json) THEN len(json_keys(aspect_json)) ELSE 0 END::INT AS n_keys FROM {aspect_log} WHERE entity_urn IS NOT NULL AND aspect_name IS NOT NULL""")
def _(t):
    return log.decode_change_events(t.aspect_log).select("seq", "entity_type", "entity_urn", "aspect_name", "change_type", F.try_element_at("aspect", F.lit("name")).alias("name"), F.size("aspect").alias("n_keys"))


@query("s3_latest_operation", LATEST_OP)
def _(t):
    return log.latest_operation(t.operations)


@query("s4_latest_assertion_result", "SELECT assertion_urn, assertee_urn, arg_max(result_type, ts_ms) AS result_type, arg_max(lag_hours, ts_ms)::DOUBLE AS lag_hours, max(ts_ms) AS ts_ms FROM {assertion_runs} GROUP BY ALL")
def _(t):
    return log.latest_assertion_result(t.assertion_runs).withColumn("lag_hours", F.col("lag_hours").cast("double"))


@query("s5_read_dbt_semantic_models", """SELECT 'm' || p_partkey AS path, 'sm' || p_partkey AS semantic_model, 'wh.t' || p_partkey AS source_table, part, name, column_name AS "column", column_name IS NULL AS computed FROM {part} CROSS JOIN (VALUES ('entities', 'id', 'id'), ('dimensions', 'size', 'p_size'), ('measures', 'price', NULL), ('measures', 'n', 'n')) AS v(part, name, column_name)""")
def _(t):
    model = "'{\"semantic_models\":{\"x\":{\"name\":\"sm' || p_partkey || '\",\"node_relation\":{\"alias\":\"t' || p_partkey || '\",\"schema_name\":\"wh\"},\"entities\":[{\"name\":\"id\"}],\"dimensions\":[{\"name\":\"size\",\"expr\":\"p_size\"}],\"measures\":[{\"name\":\"price\",\"expr\":\"a * b\"},{\"name\":\"n\",\"expr\":\"\"}]}}}'"
    return log.dbt_features(t.part.select(F.expr("'m' || p_partkey").alias("path"), F.expr(model).alias("json")))


@query("s6_read_feature_registry", """SELECT 'v' || p_partkey AS view, 'wh.t' || p_partkey AS source_table, feature, CASE WHEN feature = 'tenure' THEN 'tenure_months' ELSE feature END AS "column", label FROM {part} CROSS JOIN (VALUES ('tenure'), ('size'), ('churned')) AS v(feature) LEFT JOIN (SELECT p_partkey AS k, 'churned' AS label FROM {part} WHERE p_partkey % 3 = 0) l ON l.k = p_partkey WHERE p_partkey % 3 <> 0 OR feature = 'churned'""")
def _(t):
    cols = "if(p_partkey % 3 = 0, array('id', 'churned'), array('id', 'tenure', 'size', 'churned'))"
    views = t.part.select(F.expr("'v' || p_partkey").alias("view"), F.expr("'wh.t' || p_partkey").alias("source_table"), F.expr("array('id')").alias("join_keys"), F.expr("map('tenure_months', 'tenure')").alias("field_mapping"), F.expr(cols).alias("columns"))
    return log.registry_features(views).join(log.label_views(views), "view", "left")


@query("s7_load_raw_csv", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM {customer}")
def _(t):
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = os.path.join(shared_dir(spark), "raw-csv", os.urandom(8).hex())
    t.customer.select(F.col("c_custkey").alias("C_CUSTKEY"), F.col("c_name").alias("C_Name"), F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment").write.option("header", True).csv(path)
    return log.load_raw_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("p1_urn_entity_type", "SELECT seq, split_part(entity_urn, ':', 3) AS entity_kind FROM {aspect_log}")
def _(t):
    return t.aspect_log.select("seq", urn.entity_type("entity_urn").alias("entity_kind"))


@query("p2_schema_field_parts", f"SELECT feature_urn, nullif(regexp_extract(source_column_urn, '{FIELD_RE}', 1), '') AS parent, nullif(regexp_extract(source_column_urn, '{FIELD_RE}', 2), '') AS field FROM {{features}}")
def _(t):
    return t.features.select("feature_urn", urn.field_parent("source_column_urn").alias("parent"), urn.field_path("source_column_urn").alias("field"))


@query("p3_dataset_parts", "SELECT dataset_urn, platform, name, env FROM {datasets}")
def _(t):
    return t.datasets.select("dataset_urn", urn.dataset_platform("dataset_urn").alias("platform"), urn.dataset_name("dataset_urn").alias("name"), urn.dataset_env("dataset_urn").alias("env"))


@query("p4_model_display_name", f"SELECT model_urn, {NAME_SQL} AS display_name FROM {{models}}")
def _(t):
    return t.models.select("model_urn", urn.model_name("name", "model_urn").alias("display_name"))


@query("p5_marker_name", "SELECT column_urn, marker_urn, list_last(string_split(marker_urn, ':')) AS marker_name FROM {column_marks}")
def _(t):
    return t.column_marks.select("column_urn", "marker_urn", urn.marker_name("marker_urn").alias("marker_name"))


@query("p6_lag_hours", f"SELECT dataset_urn, ({NOW_MS} - last_updated_ms) / 3600000.0::DOUBLE AS lag_hours, ({NOW_MS} - last_updated_ms) / 3600000.0::DOUBLE > {SLA} AS is_stale FROM ({LATEST_OP}) x")
def _(t):
    return log.latest_operation(t.operations).select("dataset_urn", rules.lag_hours("last_updated_ms", NOW_MS).alias("lag_hours"), rules.is_stale("last_updated_ms", NOW_MS, SLA).alias("is_stale"))


@query("p9_logical_type", """SELECT column_urn, CASE WHEN upper(native_type) LIKE '%CHAR%' OR upper(native_type) LIKE '%TEXT%' THEN 'string' WHEN upper(native_type) LIKE '%BOOL%' THEN 'boolean' WHEN upper(native_type) LIKE '%TIMESTAMP%' THEN 'timestamp' WHEN upper(native_type) LIKE '%NUMBER%' OR upper(native_type) LIKE '%DOUBLE%' THEN 'number' END AS logical_type FROM {schema_fields}""")
def _(t):
    return t.schema_fields.select("column_urn", text.logical_type("native_type").alias("logical_type"))


@query("p12_severity_rank", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS severity_rank FROM {models}")
def _(t):
    word = F.element_at(F.array(*[F.lit(s) for s in [*rules.SEVERITIES, "none"]]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t.models.select("c_custkey", rules.severity_rank(word).alias("severity_rank"))


@query("p14_resolve_table_name", """SELECT request, count(name)::BIGINT AS n_matches, CASE WHEN count(name) = 1 THEN max(dataset_urn) END AS dataset_urn FROM (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'l' || (p_partkey % 8) || '.t' || p_partkey WHEN 1 THEN 't' || p_partkey WHEN 2 THEN 'wh.l2.t' || p_partkey ELSE 'nothing' || p_partkey END AS request FROM {part}) r LEFT JOIN {datasets} d ON d.name = request OR ends_with(d.name, '.' || request) GROUP BY request""")
def _(t):
    from ..operators.resolve import resolve_names

    asked = t.part.select(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'l' || (p_partkey % 8) || '.t' || p_partkey WHEN 1 THEN 't' || p_partkey WHEN 2 THEN 'wh.l2.t' || p_partkey ELSE 'nothing' || p_partkey END").alias("request")).distinct()
    return resolve_names(asked, t.datasets).select("request", "n_matches", "dataset_urn")


@query("p15_name_tokens", f"SELECT model_urn, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower({NAME_SQL}), '[^a-z0-9]+'), lambda x: length(x) > 2))), ' ') AS tokens FROM {{models}}")
def _(t):
    return t.models.select("model_urn", F.array_join(F.array_sort(text.name_tokens(urn.model_name("name", "model_urn"))), " ").alias("tokens"))


@query("p16_stable_doc_id", "SELECT incident_urn, 'doc-' || left(sha256(type || ':' || resource_urn), 12) AS doc_id FROM {incidents}")
def _(t):
    return t.incidents.select("incident_urn", text.stable_id(F.lit("doc"), F.concat_ws(":", "type", "resource_urn")).alias("doc_id"))


@query("p17_numbers_and_urns_in", """SELECT doc_id, len(regexp_extract_all(' ' || text, '(?:^|[^A-Za-z0-9_.])([0-9][0-9,]*(?:\\.[0-9]+)?)', 1))::INT AS n_numbers, 'urn:li:dataset:(a,b' || doc_id || ',PROD) urn:li:tag:x' AS urns FROM {documents} WHERE NOT regexp_matches(text, '[0-9,.][^A-Za-z0-9_.]?[0-9]')""")
def _(t):
    plain = t.documents.where(~F.rlike("text", F.lit("[0-9,.][^A-Za-z0-9_.]?[0-9]")))
    prose = F.concat(F.lit("see (urn:li:dataset:(a,b"), "doc_id", F.lit(",PROD)), and urn:li:tag:x."))
    return plain.select("doc_id", F.size(text.numbers_in("text")).alias("n_numbers"), F.array_join(text.urns_in(prose), " ").alias("urns"))


@query("p18_run_footer", r"SELECT incident_urn, nullif(regexp_extract(description, '(?:^|\s)tablewarden-run=(\S+)\s*$', 1), '') AS run_id FROM {incidents}")
def _(t):
    return t.incidents.select("incident_urn", text.run_id("description").alias("run_id"))


@query("p19_classify_title", "SELECT incident_urn, CASE WHEN title LIKE 'Stale upstream data in %' THEN 'upstream_freshness' WHEN title LIKE 'Training-serving schema drift in %' THEN 'input_schema_drift' WHEN title LIKE 'Deprecated training input %' THEN 'deprecated_input' END AS finding_type FROM {incidents}")
def _(t):
    return t.incidents.select("incident_urn", text.classify_title("title").alias("finding_type"))


@query("p20_idle_days", f"SELECT model_urn, greatest({NOW_MS} - greatest(created_ms, last_modified_ms, date_ms), 0) / 86400000.0::DOUBLE AS idle_days FROM {{models}} WHERE greatest(created_ms, last_modified_ms, date_ms) IS NOT NULL UNION ALL SELECT model_urn, NULL FROM {{models}} WHERE greatest(created_ms, last_modified_ms, date_ms) IS NULL")
def _(t):
    return t.models.select("model_urn", rules.idle_days(rules.last_touched("created_ms", "last_modified_ms", "date_ms"), NOW_MS).alias("idle_days"))


@query("p21_iolet", f"SELECT DISTINCT CASE split_part(entity_urn, ':', 3) WHEN 'schemaField' THEN regexp_extract(entity_urn, '{FIELD_RE}', 1) ELSE entity_urn END AS iolet FROM {{aspect_log}} WHERE entity_urn IS NOT NULL")
def _(t):
    return t.aspect_log.select(urn.touched_entity("entity_urn").alias("iolet")).where("iolet is not null").distinct()


@query("p22_history_entry", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 101)::INT END AS score, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'r' || c_custkey END AS run_id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'v2' ELSE '' END AS version FROM {models}""")
def _(t):
    from ..operators.history import parse_trust_entry

    raw = F.expr("concat_ws('|', '17', 'r' || c_custkey, if(c_custkey % 5 = 0, 'bad', string(c_custkey % 101)), 'watch', 'leakage,drift', if(c_custkey % 2 = 0, 'v2', null))")
    return t.models.select("c_custkey", parse_trust_entry(raw).alias("e")).select("c_custkey", "e.score", "e.run_id", "e.version")


@query("p23_neutralize_text", "SELECT doc_id, md5(replace(text, '.', '[removed]') || '[removed] b<evidences>') AS neutral FROM {documents}")
def _(t):
    return t.documents.select("doc_id", F.md5(text.neutralize(F.concat(F.replace("text", F.lit("."), F.lit("<Evidence\n>")), F.lit("< / EVIDENCE > b<evidences>")))).alias("neutral"))


@query("p24_feature_source_filter", f"SELECT feature_urn FROM {{features}} WHERE nullif(regexp_extract(source_column_urn, '{FIELD_RE}', 1), '') IS NOT NULL")
def _(t):
    return t.features.where(urn.field_parent("source_column_urn").isNotNull()).select("feature_urn")


@query("p26_discover_models", "SELECT DISTINCT model_urn FROM {models} WHERE NOT removed ORDER BY 1")
def _(t):
    return t.models.where("not removed").select("model_urn").distinct().orderBy("model_urn")
