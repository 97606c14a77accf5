"""Catalog tables made from the star-schema tables, by SQL that Spark and the oracle share.

{name} refers to a base table or to another of these tables; MS(x) is epoch milliseconds, rounded down.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.steps import cut

NOW_MS, DAY, HOUR = 1_706_659_200_000, 86_400_000, 3_600_000

LABEL, PII, SECRET, AGE, GENDER = "urn:li:glossaryTerm:Label", "urn:li:tag:pii", "urn:li:glossaryTerm:secret", "urn:li:tag:age", "urn:li:glossaryTerm:gender"

_FIELD = "CASE {i} WHEN 0 THEN 'id' WHEN 1 THEN 'updated_at' WHEN 2 THEN 'churned' ELSE 'f' || {i} END"
_DS = "'urn:li:dataset:(urn:li:dataPlatform:' || CASE {k} % 3 WHEN 0 THEN 'snowflake' WHEN 1 THEN 'bigquery' ELSE 'hive' END || ',wh.l' || ({k} % 4) || '.t' || {k} || ',PROD)'"


def _ds(k: str) -> str:
    return _DS.replace("{k}", f"({k})")


def _field(i: str) -> str:
    return _FIELD.replace("{i}", f"({i})")


def _col(k: str, i: str) -> str:
    return f"'urn:li:schemaField:(' || {_ds(k)} || ',' || {_field(i)} || ')'"


_MODEL = "'urn:li:mlModel:(urn:li:dataPlatform:mlflow,m' || c_custkey || ',PROD)'"
_RUN = "'urn:li:dataProcessInstance:run_' || c_custkey || '_' || r"

TABLES = {
    "size_of": "SELECT count(*) AS n FROM {part}",
    "datasets": f"SELECT p_partkey AS k, {_ds('p_partkey')} AS dataset_urn, 'wh.l' || (p_partkey % 4) || '.t' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'snowflake' WHEN 1 THEN 'bigquery' ELSE 'hive' END AS platform, 'PROD' AS env FROM {{part}}",
    "schema_fields": f"""SELECT d.k, v.i AS ordinal, d.dataset_urn, {_field('v.i')} AS field_path, {_col('d.k', 'v.i')} AS column_urn,
        CASE (d.k + v.i) % 5 WHEN 0 THEN 'VARCHAR(20)' WHEN 1 THEN 'NUMBER' WHEN 2 THEN 'BOOLEAN' WHEN 3 THEN 'TIMESTAMP_NTZ' ELSE 'DOUBLE' END AS native_type,
        (d.k + v.i) % 2 = 0 AS nullable, v.i = 0 AS is_part_of_key, v.i = 1 AND d.k % 5 = 0 AS is_partitioning_key, v.i = 0 AND d.k % 2 = 0 AS is_primary_key
        FROM {{datasets}} d CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(i)""",
    "edge_keys": """SELECT least(a, b) AS ua, i AS ui, greatest(a, b) AS da, j AS di FROM (
          SELECT l_partkey AS a, (l_orderkey * 7 + l_suppkey * 13) % n + 1 AS b, l_linenumber % 6 AS i, l_orderkey % 6 AS j FROM {lineitem} CROSS JOIN {size_of} WHERE l_linenumber = 1 AND l_orderkey % 4 = 0) x WHERE a <> b
        UNION SELECT p * 10 + 1, 3, p * 10 + q, 4 FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) AS t(p) CROSS JOIN (VALUES (2), (3), (4)) AS u(q)
        UNION SELECT p * 10 + q, 4, p * 10 + 5, 5 FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) AS t(p) CROSS JOIN (VALUES (2), (3), (4)) AS u(q)
        UNION SELECT 7, 1, p_partkey, 1 FROM {part} WHERE p_partkey % 20 = 9
        UNION SELECT 96, 2, 97, 2 FROM {size_of} UNION SELECT 97, 2, 98, 2 FROM {size_of} UNION SELECT 98, 2, 96, 2 FROM {size_of}""",
    "column_lineage": f"SELECT {_col('ua', 'ui')} AS upstream_column_urn, {_col('da', 'di')} AS downstream_column_urn, ua, da FROM {{edge_keys}}",
    "table_lineage": f"SELECT DISTINCT {_ds('ua')} AS upstream_urn, {_ds('da')} AS downstream_urn FROM {{edge_keys}} WHERE ua <> da",
    "models": f"""SELECT c_custkey, {_MODEL} AS model_urn, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '' ELSE 'model ' || c_custkey || '_' || lower(c_mktsegment) END AS name,
        'v' || (c_custkey % 4) AS version, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {NOW_MS} - (c_custkey % 200) * {DAY} END AS created_ms,
        CASE WHEN c_custkey % 13 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE {NOW_MS} - (c_custkey % 150) * {DAY} + c_custkey END AS last_modified_ms,
        CASE WHEN c_custkey % 11 = 0 THEN {NOW_MS} + {DAY} END AS date_ms, c_custkey % 17 = 0 AS removed, c_custkey % 3 <> 0 AS is_latest FROM {{customer}}""",
    "features": f"""SELECT 'urn:li:mlFeature:(ns' || o_custkey || ',f' || o_orderkey || ')' AS feature_urn, 'f' || o_orderkey AS feature_name, o_custkey, o_orderkey, {_ds('o_orderkey * 31 % n + 1')} AS source_dataset_urn,
        CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 8 = 7 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'urn:li:schemaField:(broken' ELSE {_col('o_orderkey * 31 % n + 1', 'o_orderkey % 6')} END AS source_column_urn FROM {{orders}} CROSS JOIN {{size_of}}""",
    "model_features": f"SELECT {_MODEL} AS model_urn, feature_urn, o_orderkey AS pos FROM (SELECT o_custkey AS c_custkey, feature_urn, o_orderkey FROM {{features}}) f WHERE c_custkey % 9 <> 0",
    "model_runs": f"SELECT {_MODEL} AS model_urn, {_RUN} AS run_urn, r AS pos, c_custkey FROM {{customer}} CROSS JOIN (VALUES (0), (1)) AS v(r) WHERE c_custkey % 10 <> 3 AND (r = 0 OR c_custkey % 2 = 0)",
    "input_keys": "SELECT DISTINCT c_custkey, run_urn, pos, (c_custkey * 7 + q * (6 * c_custkey + pos)) % n + 1 AS k FROM {model_runs} CROSS JOIN {size_of} CROSS JOIN (VALUES (0), (1)) AS v(q) WHERE c_custkey % 19 <> 0 AND (q = 0 OR c_custkey % 4 <> 0)",
    "run_inputs": f"SELECT run_urn, {_ds('k')} AS dataset_urn, k, c_custkey FROM {{input_keys}}",
    "model_lineage": f"SELECT {_MODEL} AS model_urn, {_ds('(c_custkey * 11 + q) % n + 1')} AS dataset_urn FROM {{customer}} CROSS JOIN {{size_of}} CROSS JOIN (VALUES (0), (1)) AS v(q) WHERE c_custkey % 4 <> 3 AND (q = 0 OR c_custkey % 8 = 2)",
    "run_properties": """SELECT run_urn, CASE c_custkey % 4 WHEN 0 THEN 'feature_table' WHEN 1 THEN 'Training_Data' WHEN 2 THEN 'loss' ELSE 'dataset' END AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 's3://lake/t' || (c_custkey % n + 1) ELSE 'wh.l' || ((c_custkey % n + 1) % 4) || '.t' || (c_custkey % n + 1) END AS value FROM {model_runs} CROSS JOIN {size_of}""",
    "training_snapshots": "SELECT run_urn, dataset_urn, k, c_custkey FROM {run_inputs} WHERE (c_custkey + k) % 3 <> 0",
    "training_schema": """SELECT s.run_urn, s.dataset_urn, f.field_path, CASE WHEN (s.k + s.c_custkey + f.ordinal) % 13 = 0 THEN 'TEXT' ELSE f.native_type END AS native_type FROM {training_snapshots} s JOIN {schema_fields} f ON f.k = s.k WHERE (s.k + s.c_custkey + f.ordinal) % 11 <> 0 AND (s.c_custkey + s.k) % 23 <> 0
        UNION ALL SELECT run_urn, dataset_urn, 'legacy', 'NUMBER' FROM {training_snapshots} WHERE (c_custkey + k) % 7 = 0""",
    "model_deployments": f"SELECT {_MODEL} AS model_urn, 'urn:li:mlModelDeployment:(urn:li:dataPlatform:mlflow,d' || c_custkey || '_' || r || ',PROD)' AS deployment_urn, c_mktsegment, r, c_custkey FROM {{customer}} CROSS JOIN (VALUES (0), (1)) AS v(r) WHERE c_custkey % 3 <> 0 AND (r = 0 OR c_custkey % 5 = 0)",
    "deployments": "SELECT deployment_urn, CASE WHEN c_mktsegment = 'BUILDING' OR r = 1 THEN 'IN_SERVICE' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'OUT_OF_SERVICE' END AS status FROM {model_deployments} WHERE c_mktsegment <> 'MACHINERY'",
    "owners": f"SELECT {_MODEL} AS entity_urn, 'urn:li:corpuser:u' || c_nationkey AS owner_urn FROM {{customer}} WHERE c_custkey % 6 <> 0 UNION ALL SELECT dataset_urn, 'urn:li:corpuser:u' || (k % 25) FROM {{datasets}} WHERE k % 4 <> 0",
    "operations": f"SELECT {_ds('event_id * 17 % n + 1')} AS dataset_urn, MS(ts) AS ts_ms, CASE WHEN event_id % 29 = 0 THEN NULL ELSE MS(ts) - (event_id % 100) * 60000 END AS last_updated_ms FROM {{events}} CROSS JOIN {{size_of}} WHERE event_id % 3 <> 0",
    "column_marks": f"""SELECT column_urn, '{LABEL}' AS marker_urn, 'term' AS kind, 'field' AS origin, 0 AS pos FROM {{schema_fields}} WHERE (k * 6 + ordinal) % 37 = 0 OR (k IN (11, 21, 31) AND ordinal = 3)
        UNION ALL SELECT column_urn, '{PII}', 'tag', 'field', 1 FROM {{schema_fields}} WHERE (k * 6 + ordinal) % 41 = 0 OR (k IN (41, 51) AND ordinal = 3)
        UNION ALL SELECT column_urn, '{SECRET}', 'term', 'editable', 2 FROM {{schema_fields}} WHERE (k * 6 + ordinal) % 82 = 0 OR (k * 6 + ordinal) % 59 = 0
        UNION ALL SELECT column_urn, '{AGE}', 'tag', 'editable', 0 FROM {{schema_fields}} WHERE (k * 6 + ordinal) % 43 = 0
        UNION ALL SELECT column_urn, '{GENDER}', 'term', 'field', 3 FROM {{schema_fields}} WHERE (k * 6 + ordinal) % 86 = 0 OR (k * 6 + ordinal) % 67 = 0
        UNION ALL SELECT column_urn, 'urn:li:tag:other', 'tag', 'editable', 0 FROM {{schema_fields}} WHERE (k * 6 + ordinal) % 29 = 0""",
    "deprecations": f"SELECT dataset_urn AS entity_urn, k % 10 = 0 AS deprecated, CASE WHEN k % 20 = 0 THEN 'use t' || (k + 1) WHEN k % 20 = 10 THEN '' END AS note, CASE WHEN k % 30 = 0 THEN {NOW_MS} + k * {DAY} END AS decommission_time_ms FROM {{datasets}} WHERE k % 5 = 0",
    "incidents": f"""SELECT 'urn:li:incident:i' || o_orderkey AS incident_urn, {_ds('o_orderkey * 3 % n + 1')} AS resource_urn,
        CASE o_orderkey % 4 WHEN 0 THEN 'FRESHNESS' WHEN 1 THEN 'DATA_SCHEMA' WHEN 2 THEN 'OPERATIONAL' ELSE 'FIELD' END AS type,
        CASE o_orderkey % 4 WHEN 0 THEN 'Stale upstream data in wh.l' || ((o_orderkey * 3 % n + 1) % 4) || '.t' || (o_orderkey * 3 % n + 1) WHEN 1 THEN 'Training-serving schema drift in x for y' WHEN 2 THEN 'Deprecated training input a for b' ELSE 'Something else' END AS title,
        CASE WHEN o_orderkey % 5 = 0 THEN 'written by hand' ELSE 'seen. tablewarden-run=r' || (o_orderkey % 9) END AS description,
        CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'ACTIVE' END AS state, {NOW_MS} - (o_orderkey % 90) * {HOUR} AS created_ms, {NOW_MS} - (o_orderkey % 60) * {HOUR} AS updated_ms FROM {{orders}} CROSS JOIN {{size_of}}""",
    "leak_incidents": f"""SELECT 'urn:li:incident:l' || o_orderkey AS incident_urn, CASE WHEN o_orderkey % 3 = 0 THEN replace(source_column_urn, ',PROD),', ',PROD),gone_') ELSE source_column_urn END AS resource_urn, 'FIELD' AS type,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Target leakage: ' ELSE 'Sensitive source: ' END || 'x derives from y' AS title, 'seen. tablewarden-run=r1' AS description, CASE WHEN o_orderkey % 7 = 0 THEN 'RESOLVED' ELSE 'ACTIVE' END AS state,
        o_orderkey, o_custkey FROM {{features}} WHERE source_column_urn LIKE '%,PROD),%'""",
    "recorded_leaks": f"SELECT DISTINCT model_urn, l.resource_urn, l.o_orderkey FROM {{models}} m JOIN {{leak_incidents}} l ON l.o_custkey = m.c_custkey WHERE l.o_orderkey % 5 <> 0",
    "assertion_runs": f"SELECT 'urn:li:assertion:a' || (event_id % 400) AS assertion_urn, {_ds('(event_id % 400) * 5 % n + 1')} AS assertee_urn, 'r' || event_id AS run_id, event_id * 1000 AS ts_ms, CASE WHEN event_id % 7 < 3 THEN 'FAILURE' ELSE 'SUCCESS' END AS result_type, event_id % 50 / 4.0 AS lag_hours FROM {{events}} CROSS JOIN {{size_of}}",
    "recorded_links": f"""SELECT model_urn, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE {_ds('c_custkey * 5 % n + 1')} END AS feature_dataset_urn, CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE {_col('c_custkey * 5 % n + 1', '2')} END AS label_column_urn, CASE WHEN c_custkey % 2 = 0 THEN 'id' ELSE 'id,updated_at' END AS exclude FROM {{models}} CROSS JOIN {{size_of}} WHERE c_custkey % 3 = 0 OR c_custkey % 18 = 0""",
    "entity_properties": """SELECT model_urn AS entity_urn, 'feature_table' AS property, feature_dataset_urn AS value FROM {recorded_links} WHERE feature_dataset_urn IS NOT NULL
        UNION ALL SELECT model_urn, 'label_column', label_column_urn FROM {recorded_links} WHERE label_column_urn IS NOT NULL UNION ALL SELECT model_urn, 'excluded', exclude FROM {recorded_links}""",
    "aspect_log": f"""SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'mlModel' WHEN 1 THEN 'dataset' WHEN 2 THEN 'mlModel' ELSE 'schemaField' END AS entity_type,
        CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 4 = 1 THEN {_ds('user_id * 3 % n + 1')} WHEN event_id % 4 = 3 THEN {_col('user_id * 3 % n + 1', 'event_id % 6')} ELSE 'urn:li:mlModel:(urn:li:dataPlatform:mlflow,m' || (user_id * 3 % 150 + 1) || ',PROD)' END AS entity_urn,
        CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 4 IN (0, 2) AND event_id % 5 <> 0 THEN 'mlModelProperties' ELSE 'status' END AS aspect_name,
        CASE event_id % 9 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'PATCH' WHEN 2 THEN 'CREATE' WHEN 3 THEN 'RESTATE' ELSE 'UPSERT' END AS change_type,
        CASE WHEN event_id % 23 = 0 THEN 'not json' WHEN event_id % 3 = 0 THEN '{{{{"name":"n' || event_id || '","mlFeatures":"a,b"}}}}' ELSE '{{{{"name":"n' || event_id || '"}}}}' END AS aspect_json, ts FROM {{events}} CROSS JOIN {{size_of}}""",
}


def _spark_text(sql: str) -> str:
    return re.sub(r"MS\((\w+)\)", r"unix_millis(cast(\1 AS timestamp))", sql)


def _duck_text(sql: str) -> str:
    return re.sub(r"MS\((\w+)\)", r"(epoch_us(\1) // 1000)", sql)


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


#: Tables that walks read once a hop: made once, so that no hop scans the fact table.
MADE_ONCE = {"column_lineage", "table_lineage"}


class Fixture:
    """Tables by attribute: base tables read from files, the others from TABLES. A base table is read once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                sql = _spark_text(TABLES[name])
                made = self._spark.sql(sql, **{n: getattr(self, n) for n in _names(sql)})
                self._made[name] = cut(made) if name in MADE_ONCE else made
            else:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """Oracle SQL: `sql` with the tables that it names by {name} as common table expressions before it."""
    tables, done, begun = TABLES | (extra or {}), {}, set()

    def add(name: str) -> None:
        if name in tables and name not in begun:
            begun.add(name)
            for n in _names(tables[name]):
                add(n)
            done[name] = _fill(_duck_text(tables[name]))

    for n in _names(sql):
        add(n)
    body = _fill(_duck_text(sql))
    recursive = "RECURSIVE " if any(n.startswith("recursive_") for n in done) else ""
    return (f"WITH {recursive}" + ",\n".join(f"{n} AS ({s})" for n, s in done.items()) + "\n" if done else "") + body


def _fill(sql: str) -> str:
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", sql).replace("{{", "{").replace("}}", "}")
