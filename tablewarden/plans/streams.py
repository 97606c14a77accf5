"""Queries of streaming jobs (R items), run over a file source."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..sources import log
from ..streaming import changes
from .fixture import oracle
from .scalars import FIELD_RE
from .scoring import Scored, audit_of
from .upkeep import COMPLETE, EVERY, complete_links

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(audit_of(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql, EVERY)
        return f

    return add


def stream_of(df, files: int = 4, **options):
    """The rows as files of a folder, and a stream over it."""
    path = changes.scratch(df.sparkSession, "source")
    df.repartitionByRange(files, df.columns[0]).write.parquet(path)
    return log.change_log_stream(df.sparkSession, path, df.schema, **options)


def events(a: Scored):
    return stream_of(a.t.aspect_log.drop("ts"), maxFilesPerTrigger="2")


query("s10_change_log_source", "SELECT entity_type, count(*) AS n FROM {aspect_log} GROUP BY ALL")(lambda a: changes.run_once(events(a)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")))
query("r1_relink_stream", f"SELECT d.seq, d.entity_urn AS model_urn, coalesce(f.n, 0) AS n_features, CASE WHEN f.n IS NULL THEN 'no recorded link' END AS reason FROM {{decoded}} d LEFT JOIN (SELECT l.model_urn, count(*) AS n FROM {COMPLETE} l JOIN {{schema_fields}} s ON s.dataset_urn = l.dataset_urn WHERE NOT list_contains(string_split(l.exclude, ','), s.field_path) GROUP BY ALL) f ON f.model_urn = d.entity_urn WHERE entity_type = 'mlModel' AND aspect_name = 'mlModelProperties' AND change_type IN ('UPSERT', 'CREATE', 'RESTATE') AND coalesce(feats, '') = ''")(
    lambda a: changes.run_once(changes.relink(events(a), complete_links(a), a.t.schema_fields))
)
query("r2_touches_stream", f"SELECT seq, target FROM (SELECT seq, entity_urn AS target FROM {{aspect_log}} UNION SELECT seq, nullif(regexp_extract(entity_urn, '{FIELD_RE}', 1), '') FROM {{aspect_log}}) x WHERE target IN (SELECT dataset_urn FROM {{datasets}} WHERE k % 2 = 0)")(
    lambda a: changes.run_once(changes.touches(events(a), a.t.datasets.where("k % 2 = 0").select(F.col("dataset_urn").alias("target"))))
)
WATCH = "SELECT user_id AS target, event_id AS seq, CASE WHEN event_id % 5 < 3 THEN 'a' WHEN event_id % 7 = 0 THEN NULL ELSE 'b' END AS sig, event_id % 4 = 1 AS muted FROM {events}"
STEPS = f"SELECT *, CASE WHEN row_number() OVER w = 1 THEN CASE WHEN sig IS NULL THEN 'clean' ELSE 'detected' END WHEN sig IS NOT DISTINCT FROM lag(sig) OVER w THEN 'no change' WHEN sig IS NULL THEN 'recovered' WHEN lag(sig) OVER w IS NOT NULL THEN 'changed' ELSE 'detected' END AS transition FROM ({WATCH}) p WINDOW w AS (PARTITION BY target ORDER BY seq)"
OWED = f"SELECT target, seq, NOT muted AND coalesce(lag(c) OVER (PARTITION BY target, muted ORDER BY seq), 0) < c AS \"write\" FROM (SELECT *, sum(CASE WHEN transition <> 'no change' THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY seq) AS c FROM ({STEPS}) s) x"


def watched(a: Scored):
    polls = a.t.events.selectExpr("event_id AS seq", "user_id AS target", "CASE WHEN event_id % 5 < 3 THEN 'a' WHEN event_id % 7 = 0 THEN NULL ELSE 'b' END AS sig", "event_id % 4 = 1 AS muted")
    return changes.run_once(changes.transitions(stream_of(polls)))


query("r3_transition_stream", f"SELECT target, seq, transition FROM ({STEPS}) x")(lambda a: watched(a).select("target", "seq", "transition"))
query("r4_deferred_write", OWED)(lambda a: watched(a).select("target", "seq", "write"))


def features_named(event: dict) -> str:
    """How many features a write of model properties names; one that names none fails, as a model without features can't be replayed."""
    if event["aspect_name"] != "mlModelProperties":
        return "not about features"
    return str(len(event["aspect"]["mlFeatures"].split(",")))


query(
    "r5_bad_event_isolation",
    """SELECT seq, CASE WHEN reason IS NULL THEN 'handled' ELSE 'dead' END AS sink, CASE WHEN reason IS NULL THEN CASE WHEN aspect_name <> 'mlModelProperties' THEN 'not about features' ELSE '2' END END AS result, reason
        FROM (SELECT *, CASE WHEN entity_urn IS NULL THEN 'no entity' WHEN aspect_name IS NULL THEN 'no aspect' WHEN NOT json_valid(aspect_json) THEN 'unreadable aspect'
            WHEN aspect_name = 'mlModelProperties' AND NOT contains(aspect_json, 'mlFeatures') THEN 'handler: KeyError' END AS reason FROM {aspect_log}) x""",
)(lambda a: changes.isolate(events(a), features_named).drop("batch"))
query("r6_at_least_once_dedupe", "SELECT DISTINCT 'r' || (event_id % 700) || '-' || (event_id % 2) AS message_id FROM {events}")(
    lambda a: changes.run_once(changes.once(stream_of(a.t.events.selectExpr("event_id", "'r' || (event_id % 700) || '-' || (event_id % 2) AS message_id")))).select("message_id")
)
query("r7_latest_state_stream", "SELECT entity_urn, aspect_name, change_type, aspect_json, seq FROM (SELECT *, row_number() OVER (PARTITION BY entity_urn, aspect_name ORDER BY seq DESC) AS rn FROM {aspect_log} WHERE entity_urn IS NOT NULL AND aspect_name IS NOT NULL AND change_type <> 'PATCH') x WHERE rn = 1 AND change_type <> 'DELETE'")(
    lambda a: changes.latest_state(events(a))
)
