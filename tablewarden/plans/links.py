"""Queries of inferred links, of what is said of findings, and of a policy by score alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linking, quality, score
from .fixture import oracle
from .scoring import Scored, audit_of
from .upkeep import EVERY, SQL_J28, labels_inferred

QUERIES, SQL = {}, {}
KEYS = "[" + ", ".join(f"'{k}'" for k in linking.PARAMETER_KEYS) + "]"
#: Names of tables with a business word, so that models and tables have words to share.
WIDE_NAME = "name || '.' || CASE k % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'model' ELSE 'machinery' END"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(audit_of(spark, sf_dir))
        SQL[name] = oracle(sql, EVERY | PARTS)
        return f

    return add


PARTS = {
    "wide_names": f"SELECT dataset_urn, {WIDE_NAME} AS name FROM {{datasets}}",
    "param_values": f"""SELECT m.model_urn, list_position({KEYS}, lower(key)) AS rank, arg_min(value, (m.pos, m.run_urn, key, value)) AS value FROM {{model_runs}} m
        JOIN {{run_properties}} p ON p.run_urn = m.run_urn WHERE list_position({KEYS}, lower(key)) > 0 AND value IS NOT NULL GROUP BY ALL""",
    "param_hits": """SELECT p.model_urn, rank, d.dataset_urn FROM {param_values} p JOIN {datasets} d
        ON list_last(string_split(trim(trim(value), '/'), '/')) IN (d.name, list_last(string_split(d.name, '.')))""",
    "param_tables": f"""SELECT model_urn, {KEYS}[any_value(rank)] AS key, list(DISTINCT dataset_urn ORDER BY dataset_urn) AS l FROM {{param_hits}} h
        WHERE rank = (SELECT min(rank) FROM {{param_hits}} o WHERE o.model_urn = h.model_urn) GROUP BY model_urn""",
    "input_tables": "SELECT model_urn, list(DISTINCT dataset_urn ORDER BY dataset_urn) AS l FROM {inputs} GROUP BY ALL",
    "lineage_tables": "SELECT model_urn, list(DISTINCT dataset_urn ORDER BY dataset_urn) AS l FROM {model_lineage} GROUP BY ALL",
    "routes": """SELECT r.model_urn, r.name, p.key, CASE WHEN len(i.l) = 1 THEN i.l WHEN len(p.l) = 1 THEN p.l WHEN len(u.l) = 1 THEN u.l END AS one, coalesce(i.l, p.l, u.l) AS some,
        CASE WHEN len(i.l) = 1 THEN 'run input' WHEN len(p.l) = 1 THEN 'run parameter' WHEN len(u.l) = 1 THEN 'lineage' WHEN coalesce(i.l, p.l, u.l) IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS route
        FROM {refs} r LEFT JOIN {input_tables} i ON i.model_urn = r.model_urn LEFT JOIN {param_tables} p ON p.model_urn = r.model_urn LEFT JOIN {lineage_tables} u ON u.model_urn = r.model_urn""",
    "model_words": "SELECT DISTINCT model_urn, w FROM (SELECT model_urn, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS w FROM {refs}) x WHERE length(w) > 2",
    "table_words": "SELECT DISTINCT dataset_urn, w FROM (SELECT dataset_urn, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS w FROM {wide_names}) x WHERE length(w) > 2",
    "first_tables": "SELECT w, dataset_urn FROM {table_words} QUALIFY row_number() OVER (PARTITION BY w ORDER BY dataset_urn) <= 5",
    "short": """SELECT model_urn, dataset_urn, row_number() OVER (PARTITION BY model_urn ORDER BY dataset_urn)::INT AS place
        FROM (SELECT DISTINCT m.model_urn, d.dataset_urn FROM {model_words} m JOIN {first_tables} d ON d.w = m.w) x QUALIFY place <= 5""",
    "inferred": """SELECT r.model_urn, r.one[1] AS dataset_urn, r.route, CASE WHEN r.route = 'run parameter' THEN r.key END AS key,
        CASE r.route WHEN 'ambiguous' THEN r.some WHEN 'none' THEN coalesce((SELECT list(s.dataset_urn ORDER BY s.dataset_urn) FROM {short} s WHERE s.model_urn = r.model_urn), []) ELSE [] END AS candidates FROM {routes} r""",
    "labels_of": SQL_J28,
    "excluded_of": """SELECT dataset_urn, list(DISTINCT column_urn ORDER BY column_urn) AS l FROM (SELECT dataset_urn, column_urn FROM {schema_fields} WHERE is_primary_key OR is_part_of_key OR is_partitioning_key
        UNION SELECT dataset_urn, column_urn FROM {labels_of}) x GROUP BY ALL""",
    "said": f"""SELECT 'stale ' || s.dataset_urn AS id, split_part(split_part(s.dataset_urn, ',', 1), ':', 7) AS provider, d.k, s.dataset_urn, s.lag_hours FROM {{stale}} s JOIN {{datasets}} d ON d.dataset_urn = s.dataset_urn""",
    "checked": """SELECT id, provider, 2 + (k % 4 = 0)::INT AS numbers_checked, 1 + (k % 3 = 0)::INT AS urns_checked,
        list_concat(CASE WHEN k % 4 = 0 THEN ['number 31.25'] ELSE [] END, CASE WHEN k % 3 = 0 THEN ['urn urn:li:tag:lost' || k] ELSE [] END) AS v FROM {said}""",
}


def tables_inferred(a: Scored) -> DataFrame:
    names = a.t.datasets.select("dataset_urn", "name")
    return linking.infer_feature_table(a.refs, a.t.model_runs, a.t.run_inputs, a.t.run_properties, a.t.model_lineage, names)


def with_shortlist(a: Scored) -> DataFrame:
    """Routes over the tables' names; the words that models share with tables come from the wider names."""
    found = tables_inferred(a)
    short = linking.shortlist(a.refs, wide(a)).groupBy("model_urn").agg(F.array_sort(F.collect_list("dataset_urn")).alias("short"))
    rows = found.join(short, "model_urn", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("candidates", F.when(F.col("route") == "none", F.coalesce("short", none)).otherwise(F.col("candidates"))).drop("short")


def wide(a: Scored) -> DataFrame:
    return a.t.datasets.select("dataset_urn", F.expr(WIDE_NAME).alias("name"))


@query("t3_shortlist_top5", "SELECT * FROM {short}")
def shortlist(a: Scored) -> DataFrame:
    return linking.shortlist(a.refs, wide(a)).select("model_urn", "dataset_urn", "place")


@query("j27_infer_feature_table", "SELECT model_urn, dataset_urn, route, key, array_to_string(candidates, ' ') AS candidates FROM {inferred}")
def feature_table(a: Scored) -> DataFrame:
    return with_shortlist(a).withColumn("candidates", F.array_join("candidates", " "))


_REASON = "CASE route " + " ".join(f"WHEN '{r}' THEN 'table: {w.replace(chr(39), chr(39) * 2)}' || coalesce(key, '')" for r, w in linking.TABLE_REASONS.items()) + " END"
PROPOSALS = f"""
SELECT t.model_urn, t.dataset_urn, l.column_urn AS label_column_urn, coalesce(array_to_string(e.l, ' '), '') AS excluded, array_to_string(t.candidates, ' ') AS candidates,
    t.dataset_urn IS NOT NULL AND l.column_urn IS NOT NULL AS complete, concat_ws('; ', {_REASON},
        'label: ' || CASE WHEN t.dataset_urn IS NULL THEN 'not inferred without a table' ELSE coalesce(l.reason, 'no column is marked, derives from a label or has its name') END,
        'excluded: ' || CASE WHEN t.dataset_urn IS NULL THEN 'not inferred without a table' WHEN e.l IS NULL THEN 'no declared key' ELSE len(e.l) || ' declared keys and labels' END) AS reasons
FROM {{inferred}} t LEFT JOIN {{labels_of}} l ON l.dataset_urn = t.dataset_urn LEFT JOIN {{excluded_of}} e ON e.dataset_urn = t.dataset_urn
"""


@query("j41_link_proposals", PROPOSALS)
def proposals(a: Scored) -> DataFrame:
    labels = labels_inferred(a)
    made = linking.propose_links(with_shortlist(a), labels, linking.infer_excluded(a.t.schema_fields, labels))
    flat = {c: F.array_join(c, sep) for c, sep in (("excluded", " "), ("candidates", " "), ("reasons", "; "))}
    return made.withColumns(flat)


def narratives(a: Scored) -> DataFrame:
    """What might be said of each stale table; some texts add a figure, some name an entity that does not exist."""
    rows = a.stale.join(a.t.datasets.select("dataset_urn", "k"), "dataset_urn")
    hours = F.format_string("%.1f", "lag_hours")
    prose = F.concat(F.lit("Data of "), F.col("dataset_urn"), F.lit(" is "), hours, F.lit(" hours old; 48 are allowed."), F.when(F.col("k") % 4 == 0, " It was 31.25 last week.").otherwise(""), F.when(F.col("k") % 3 == 0, F.concat(F.lit(" See (urn:li:tag:lost"), "k", F.lit(")."))).otherwise(""))
    facts = F.concat(F.lit("lag "), hours, F.lit("; limit 48.0"))
    return rows.select(F.concat(F.lit("stale "), "dataset_urn").alias("id"), F.regexp_extract("dataset_urn", "dataPlatform:([^,]+)", 1).alias("provider"), facts.alias("facts"), prose.alias("prose"))


def checks(a: Scored) -> DataFrame:
    entities = a.t.datasets.select(F.col("dataset_urn").alias("urn")).unionByName(a.t.models.select(F.col("model_urn").alias("urn")))
    return quality.faithfulness(narratives(a), entities)


@query("a15_faithfulness", "SELECT id, provider, numbers_checked, urns_checked, array_to_string(v, '; ') AS violations, len(v) = 0 AS faithful FROM {checked}")
def faithfulness(a: Scored) -> DataFrame:
    said = F.array_join(F.transform("violations", lambda v: F.concat(v["kind"], F.lit(" "), v["token"])), "; ")
    return checks(a).withColumn("violations", said)


RATES = "count(*) AS narratives, sum(numbers_checked)::BIGINT AS numbers_checked, sum(urns_checked)::BIGINT AS urns_checked, sum(len(v))::BIGINT AS violations, avg(CASE WHEN len(v) = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate"


@query("a15_faithfulness_rates", f"SELECT provider, {RATES} FROM {{checked}} GROUP BY ALL UNION ALL SELECT 'all', {RATES} FROM {{checked}}")
def rates(a: Scored) -> DataFrame:
    return quality.faithfulness_rates(checks(a))


CAUTION = score.policy_caution(None, 40)


@query("g1_trust_only_policy", f"SELECT model_urn, 'trust' AS rule, 'score ' || score || ' below 40' AS detail, '{CAUTION}' AS caution FROM {{banded}} WHERE score < 40")
def trust_only(a: Scored) -> DataFrame:
    return score.gate_violations(a.findings, a.scores, None, 40).withColumn("caution", F.lit(CAUTION))
