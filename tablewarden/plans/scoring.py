"""Queries of scores, coverage and gates (A, G, T, U and further P items)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import coverage, score, tables, tally
from ..operators.steps import cut
from ..sources import log
from ..sources.state import Files
from .audit import Audit
from .detection import CHAINS, COARSE, coarse  # noqa: F401
from .fixture import PII, SECRET, Fixture, oracle
from .oracle_parts import PARTS
from .scalars import SLA

QUERIES, SQL = {}, {}
COMMON = ["finding_type", "model_urn", "resource_urn", "title", "severity"]
ONE = "finding_type, model_urn, resource_urn, title, severity"
FINDINGS = {
    "findings_raw": f"SELECT 'upstream_freshness' AS finding_type, x.model_urn, r.resource_urn, r.title, r.severity, least(r.lag_hours / r.sla_hours, 1.0) AS lag_ratio FROM {{radii}} r JOIN {{radius}} x ON x.root = r.resource_urn "
    + " ".join(f"UNION ALL SELECT {ONE}, NULL FROM {{{p}}}" for p in ("leaks", "exposures", "proxies", "drifts", "deprecated", "table_risks")),
    "findings": """SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank,
        CASE WHEN finding_type = 'upstream_freshness' OR title LIKE 'Table-level stale %' THEN 'FRESHNESS' WHEN finding_type IN ('target_leakage', 'sensitive_source', 'proxy_candidate') THEN 'FIELD' WHEN finding_type = 'input_schema_drift' THEN 'DATA_SCHEMA' ELSE 'OPERATIONAL' END AS incident_type FROM {findings_raw}""",
    "trust_in": """SELECT f.model_urn, r.name, r.has_owner, bool_or(finding_type = 'upstream_freshness') AS upstream_failure, bool_or(finding_type = 'target_leakage') AS leakage, bool_or(finding_type = 'input_schema_drift') AS schema_drift, bool_or(finding_type = 'sensitive_source') AS sensitive_source,
        bool_or(finding_type = 'deprecated_input') AS deprecated_input, min(severity_rank) AS worst, coalesce(max(lag_ratio), 0) AS lag_ratio, NOT r.has_owner AS missing_owner FROM {findings} f JOIN {refs} r ON r.model_urn = f.model_urn WHERE finding_type NOT IN ('proxy_candidate', 'table_level_risk') GROUP BY f.model_urn, r.name, r.has_owner""",
    "pts": "SELECT *, upstream_failure::INT * 40.0 AS p1, leakage::INT * 20.0 AS p2, schema_drift::INT * 15.0 AS p3, lag_ratio * 15.0 AS p4, sensitive_source::INT * 15.0 AS p5, missing_owner::INT * 10.0 AS p6, deprecated_input::INT * 5.0 AS p7 FROM {trust_in}",
    "scored": "SELECT model_urn, name, worst, round_even(greatest(0.0, least(100.0, 100.0 - (p1 + p2 + p3 + p4 + p5 + p6 + p7))), 0)::INT AS score, list_sort(list_filter([{'neg': -p1, 'name': 'upstream_failure'}, {'neg': -p2, 'name': 'leakage'}, {'neg': -p3, 'name': 'schema_drift'}, {'neg': -p4, 'name': 'freshness_lag'}, {'neg': -p5, 'name': 'sensitive_source'}, {'neg': -p6, 'name': 'missing_owner'}, {'neg': -p7, 'name': 'deprecated_input'}], lambda x: x.neg < 0)) AS d FROM {pts}",
    "banded": "SELECT *, CASE WHEN score >= 70 AND worst > 1 THEN 'healthy' WHEN score >= 40 THEN 'watch' ELSE 'at_risk' END AS band FROM {scored}",
    "violations": "SELECT model_urn, 'severity' AS rule, severity || ': ' || title AS detail FROM {findings} WHERE severity_rank <= 1 UNION ALL SELECT model_urn, 'trust', 'score ' || score || ' below 40' FROM {banded} WHERE score < 40",
    "run_facts": "SELECT r.model_urn, count(*) AS n_runs, count(CASE WHEN r.run_urn IN (SELECT run_urn FROM {run_inputs}) THEN 1 END) AS n_inputs, count(CASE WHEN r.run_urn IN (SELECT run_urn FROM {training_snapshots}) THEN 1 END) AS n_snapshots FROM {model_runs} r GROUP BY r.model_urn",
    "cone_flags": "SELECT root, count(*) >= 500 AS truncated, max(hops) > 6 AS hop_capped FROM {cone} WHERE node <> root GROUP BY root",
    "cap_facts": "SELECT l.model_urn, bool_or(truncated) AS truncated, bool_or(hop_capped) AS hop_capped FROM {linked} l JOIN {cone_flags} c ON c.root = l.source GROUP BY l.model_urn",
    "gap_facts": """SELECT m.model_urn, coalesce(f.n, 0) AS nf, coalesce(s.n, 0) AS ns, coalesce(k.truncated, false) AS truncated, coalesce(k.hop_capped, false) AS hop_capped, m.model_urn IN (SELECT model_urn FROM {recorded_links} WHERE feature_dataset_urn IS NOT NULL AND label_column_urn IS NOT NULL) AS was_linked,
        coalesce(r.n_runs, 0) AS n_runs, coalesce(r.n_inputs, 0) AS n_inputs, coalesce(r.n_snapshots, 0) AS n_snapshots, c.chk FROM {models} m LEFT JOIN (SELECT model_urn, count(DISTINCT feature_urn) AS n FROM {model_features} GROUP BY ALL) f ON f.model_urn = m.model_urn
        LEFT JOIN (SELECT model_urn, count(DISTINCT feature_urn) AS n FROM {linked} GROUP BY ALL) s ON s.model_urn = m.model_urn LEFT JOIN {cap_facts} k ON k.model_urn = m.model_urn LEFT JOIN {run_facts} r ON r.model_urn = m.model_urn
        CROSS JOIN (VALUES ('target_leakage'), ('schema_drift'), ('sensitive_source'), ('deprecated_input'), ('proxy_candidate')) AS c(chk)""",
    "gaps_all": """SELECT model_urn, chk AS "check", CASE WHEN chk IN ('schema_drift', 'deprecated_input') AND n_runs = 0 THEN 'no training run' WHEN chk = 'schema_drift' THEN CASE WHEN n_snapshots = 0 THEN 'no input with a snapshot' END WHEN chk = 'deprecated_input' THEN CASE WHEN n_inputs = 0 THEN 'runs record no inputs' END
        WHEN nf = 0 AND was_linked THEN 'de-linked' WHEN nf = 0 THEN 'no features' WHEN chk = 'proxy_candidate' THEN NULL WHEN ns = 0 THEN 'no source columns' WHEN ns < nf THEN (nf - ns) || ' of ' || nf || ' features have no source column' WHEN truncated AND hop_capped THEN 'result cap and hop cap' WHEN truncated THEN 'result cap' WHEN hop_capped THEN 'hop cap' END AS reason FROM {gap_facts}""",
    "gaps": """SELECT g.* FROM {gaps_all} g WHERE reason IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {findings} f WHERE f.model_urn = g.model_urn AND CASE f.finding_type WHEN 'input_schema_drift' THEN 'schema_drift' ELSE f.finding_type END = g."check")""",
    "cures": """SELECT *, CASE WHEN reason IN ('no features', 'de-linked') THEN 'declare the model''s features' WHEN reason LIKE '%source column%' THEN 'ingest column lineage' WHEN reason LIKE '%cap%' THEN 'raise the cap' WHEN reason = 'no input with a snapshot' THEN 'record the training schema' ELSE 'record training runs with inputs' END AS remedy FROM {gaps}""",
}
ALL = PARTS | FINDINGS


class Scored(Audit):
    """The audit with its findings in one table."""

    @property
    def findings(self):
        if not hasattr(self, "_findings"):
            self._findings = cut(score.model_findings(self.radii, self.leaks, self.exposures, self.proxies, self.drifts, self.deprecated, self.table_risks))
        return self._findings

    @property
    def inputs_of_trust(self):
        return score.trust_inputs(self.findings, self.refs)

    @property
    def scores(self):
        if not hasattr(self, "_scores"):
            self._scores = cut(score.trust_scores(self.inputs_of_trust))
        return self._scores

    @cached_property
    def model_tally(self):
        """(model_urn, finding_type, n, lag_hours): all findings, counted by model and type; with the greatest lag of stale tables."""
        t, rows = self.t, self.feature_tally
        late = cut(tally.freshness(self.stale, t.table_lineage, t.features, t.model_features, self.hops))
        linked = rows.where("with_source > 0").select("model_urn")
        risks = tables.table_level_risks(self.training_tables, linked, self.refs, self.stale, t.deprecations, self.marks(PII, SECRET))
        stale = tally.found({"upstream_freshness": late}, t.models).join(late.select("model_urn", "lag_hours"), "model_urn")
        coarse = risks.groupBy("model_urn").agg(F.count(F.lit(1)).alias("n")).withColumn("finding_type", F.lit("table_level_risk"))
        return cut(stale.unionByName(self.check_tally.unionByName(coarse), allowMissingColumns=True))

    @property
    def points(self):
        """(model_urn, score): the scores alone, from counts."""
        return score.points(self.model_tally, self.refs, self.sla)

    @property
    def gaps(self):
        if not hasattr(self, "_gaps"):
            self._gaps = cut(self._find_gaps())
        return self._gaps

    def _find_gaps(self):
        kinds = F.element_at(F.create_map(*[F.lit(x) for kv in coverage.FOUND_AS.items() for x in kv]), F.col("finding_type"))
        found = self.check_tally.select("model_urn", kinds.alias("check"))
        return coverage.model_gaps(self.t.models, self.feature_tally, self.t.recorded_links, self.t.model_runs, self.t.run_inputs, self.t.training_snapshots, found)


def audit_of(spark, sf_dir: str) -> Scored:
    """The audit of a catalog, made once in an application: its checkpointed findings serve every query.

    When a file of the catalog comes, goes or changes, the next call makes a new audit.
    """
    key = (spark.sparkContext.applicationId, sf_dir, Files(spark, sf_dir).stamp(sf_dir))
    if key not in _AUDITS:
        _AUDITS.clear()
        _AUDITS[key] = Scored(Fixture(spark, sf_dir))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _AUDITS[key]


_AUDITS: dict[tuple, Scored] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(audit_of(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql, ALL | (extra or {}))
        return f

    return add


query("t1_findings_worst_first", "SELECT * EXCLUDE (severity_rank), severity_rank::INT AS severity_rank FROM {findings} ORDER BY severity_rank, title")(lambda a: a.findings.orderBy("severity_rank", "title"))
query("p10_finding_title", "SELECT DISTINCT finding_type, resource_urn, title FROM {findings}")(lambda a: a.findings.select("finding_type", "resource_urn", "title").distinct())
query("p13_severity_rules", "SELECT finding_type, severity, count(*) AS n FROM {findings} GROUP BY ALL")(lambda a: a.findings.groupBy("finding_type", "severity").agg(F.count(F.lit(1)).alias("n")))
query("a1_trust_inputs", "SELECT * EXCLUDE (worst), worst::INT AS worst FROM {trust_in}")(lambda a: a.inputs_of_trust.drop(*[f"{n}_cause" for n in score.SCORED.values()]))
query("a2_trust_score", "SELECT model_urn, score, band, array_to_string(list_transform(d, lambda x: x.name), ',') AS deductions FROM {banded}")(
    lambda a: a.scores.select("model_urn", "score", "band", F.array_join(F.transform("deductions", lambda d: d["name"]), ",").alias("deductions"))
)
query("a3_trust_per_model", "SELECT model_urn, name, score, band FROM {banded} ORDER BY score, model_urn")(lambda a: a.scores.select("model_urn", "name", "score", "band").orderBy("score", "model_urn"))
query("p27_waterfall_lines", "SELECT model_urn, '  100  starting' || coalesce(array_to_string(list_transform(d, lambda x: chr(10) || lpad(printf('-%.0f', -x.neg), 5, ' ') || '  ' || x.name), ''), '') || chr(10) || '-----' || chr(10) || lpad(score || '', 5, ' ') || '  ' || band AS lines FROM {banded}")(
    lambda a: score.waterfall(a.scores).select("model_urn", F.array_join("lines", "\n").alias("lines"))
)
query("a4_coverage_gaps", "SELECT * FROM {gaps}")(lambda a: a.gaps)
query("a5_freshness_gaps", "SELECT dataset_urn, 'no operation' AS reason FROM {datasets} WHERE dataset_urn NOT IN (SELECT dataset_urn FROM {latest_op})")(lambda a: coverage.freshness_gaps(a.t.datasets, log.latest_operation(a.t.operations)))
query("a6_guard_coverage", """SELECT coalesce("check", 'all') AS "check", sum(n - m)::BIGINT AS covered, sum(n)::BIGINT AS total, sum(n - m) / sum(n)::DOUBLE AS rate FROM (SELECT c."check", t.n, (SELECT count(DISTINCT model_urn) FROM {gaps} g WHERE g."check" = c."check") AS m FROM (SELECT DISTINCT "check" FROM {gaps_all}) c CROSS JOIN (SELECT count(DISTINCT model_urn) AS n FROM {models}) t) x GROUP BY ROLLUP ("check")""")(
    lambda a: coverage.guard_coverage(a.gaps, a.t.models)
)
query("a7_next_join", "SELECT remedy, count(*) AS pairs, count(DISTINCT model_urn) AS n_models, md5(string_agg(DISTINCT model_urn, ' ' ORDER BY model_urn)) AS models FROM {cures} GROUP BY remedy ORDER BY 2 DESC, 3 DESC, 1 DESC LIMIT 1")(
    lambda a: coverage.next_join(a.gaps).withColumn("models", F.md5(F.array_join("models", " ")))
)
query("a17_inventory_status", "SELECT m.model_urn, coalesce(f.n, 0) AS findings, CASE f.r WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS worst, CASE WHEN f.coarse THEN 'table level only' WHEN f.n > 0 THEN 'findings' WHEN m.model_urn IN (SELECT model_urn FROM {linked}) THEN 'clean' ELSE 'not checked' END AS status FROM {models} m LEFT JOIN (SELECT model_urn, count(*) AS n, min(severity_rank) AS r, bool_and(finding_type = 'table_level_risk') AS coarse FROM {findings} GROUP BY ALL) f ON f.model_urn = m.model_urn")(
    lambda a: score.inventory(a.t.models, a.findings, a.linked)
)
query("a19_changes_count", "SELECT model_urn, run_urn, resource_urn, added, removed, retyped, drifted_fields FROM {drifts}")(lambda a: a.drifts.select("model_urn", "run_urn", "resource_urn", "added", "removed", "retyped", "drifted_fields"))
query("a22_open_leak_columns", "SELECT model_urn, string_agg(DISTINCT resource_urn, ' ' ORDER BY resource_urn) AS columns FROM {leaks} GROUP BY ALL")(lambda a: a.leaks.groupBy("model_urn").agg(F.array_join(F.sort_array(F.collect_set("resource_urn")), " ").alias("columns")))
query("a18_approach_comparison", "SELECT approach, count(CASE WHEN flagged AND truth THEN 1 END) AS tp, count(CASE WHEN flagged AND NOT truth THEN 1 END) AS fp, count(CASE WHEN NOT flagged AND truth THEN 1 END) AS fn, count(CASE WHEN NOT flagged AND NOT truth THEN 1 END) AS tn FROM (SELECT 'column' AS approach, f.feature_urn IN (SELECT feature_urn FROM {leaks}) AS flagged, f.feature_urn IN (SELECT feature_urn FROM {leaks}) AS truth FROM {features} f UNION ALL SELECT 'table', f.feature_urn IN (SELECT feature_urn FROM {coarse}), f.feature_urn IN (SELECT feature_urn FROM {leaks}) FROM {features} f) x GROUP BY ALL", COARSE)(
    lambda a: _approaches(a)
)


def _approaches(a):
    from ..operators.quality import confusion

    truth = a.leaks.select("feature_urn").distinct().withColumn("t", F.lit(True))
    rough = coarse(a).distinct().withColumn("c", F.lit(True))
    rows = a.t.features.select("feature_urn").join(truth, "feature_urn", "left").join(rough, "feature_urn", "left").na.fill(False, ["t", "c"])
    pairs = rows.select(F.lit("column").alias("approach"), F.col("t").alias("expected"), F.col("t").alias("observed")).unionByName(rows.select(F.lit("table").alias("approach"), F.col("t").alias("expected"), F.col("c").alias("observed")))
    return confusion(pairs, "approach").select("approach", "tp", "fp", "fn", "tn")


query("g1_gate_violations", "SELECT * FROM {violations}")(lambda a: score.gate_violations(a.findings, a.scores, "high", 40))
query("g2_gate_verdict", "SELECT m.model_urn, coalesce(v.n, 0) AS violations, coalesce(f.n, 0) AS findings_seen, true AS enforced, coalesce(v.n, 0) > 0 AS blocked, (coalesce(v.n, 0) > 0)::INT AS exit_code FROM {models} m LEFT JOIN (SELECT model_urn, count(*) AS n FROM {violations} GROUP BY ALL) v ON v.model_urn = m.model_urn LEFT JOIN (SELECT model_urn, count(*) AS n FROM {findings} GROUP BY ALL) f ON f.model_urn = m.model_urn")(
    lambda a: score.gate_verdict(a.t.models, score.gate_violations(a.findings, a.scores, "high", 40), a.findings)
)
query("g3_ci_annotations", "SELECT model_urn, '::error title=' || rule || ' ' || model_urn || '::' || detail AS line FROM {violations}")(lambda a: score.ci_annotations(score.gate_violations(a.findings, a.scores, "high", 40)))
query("t4_summary_top20", "SELECT model_urn, title, place::INT AS place, greatest(0, n - 20) AS more FROM (SELECT *, row_number() OVER (PARTITION BY model_urn ORDER BY severity_rank, finding_type, resource_urn, title) AS place, count(*) OVER (PARTITION BY model_urn) AS n FROM {findings}) x WHERE place <= 20")(
    lambda a: score.top_findings(a.findings).select("model_urn", "title", "place", "more")
)
query("a13_risk_flags", """SELECT coalesce(e.model_urn, c.model_urn) AS model_urn, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(e.ex, []), coalesce(c.cu, [])), lambda x: x <> 'input_schema_drift' OR list_contains(coalesce(c.cu, []), 'input_schema_drift')))), ','), '') AS flags
        FROM (SELECT model_urn, ['input_schema_drift', 'deprecated_input'] AS ex FROM {models} WHERE c_custkey % 3 = 0) e FULL JOIN (SELECT model_urn, list(DISTINCT finding_type) AS cu FROM {findings} GROUP BY ALL) c ON c.model_urn = e.model_urn""")(
    lambda a: score.risk_flags(a.t.models.where("c_custkey % 3 = 0").select("model_urn", F.array(F.lit("input_schema_drift"), F.lit("deprecated_input")).alias("existing")), a.findings.groupBy("model_urn").agg(F.collect_set("finding_type").alias("current")), a.t.models.select("model_urn", F.array(F.lit("input_schema_drift")).alias("recovered")))
    .select("model_urn", F.array_join("flags", ",").alias("flags"))
)
query("u4_cleared_flags", "SELECT model_urn, CASE WHEN model_urn IN (SELECT model_urn FROM {drifts}) THEN '' ELSE 'input_schema_drift' END AS cleared FROM {models} WHERE c_custkey % 3 = 0")(
    lambda a: score.risk_flags(a.t.models.where("c_custkey % 3 = 0").select("model_urn", F.array(F.lit("input_schema_drift"), F.lit("deprecated_input")).alias("existing")), a.drifts.groupBy("model_urn").agg(F.collect_set("finding_type").alias("current")), a.t.models.select("model_urn", F.array(F.lit("input_schema_drift")).alias("recovered")))
    .join(a.t.models.where("c_custkey % 3 = 0").select("model_urn"), "model_urn").select("model_urn", F.array_join("cleared", ",").alias("cleared"))
)
query("u7_scan_difference", "SELECT finding_type, model_urn, resource_urn, title, CASE WHEN bool_or(b) AND bool_or(NOT b) THEN 'unchanged' WHEN bool_or(b) THEN 'recovered' ELSE 'new' END AS state FROM (SELECT DISTINCT finding_type, model_urn, resource_urn, title, true AS b FROM {findings} WHERE finding_type <> 'deprecated_input' UNION ALL SELECT DISTINCT finding_type, model_urn, resource_urn, title, false FROM {findings} WHERE finding_type <> 'target_leakage') x GROUP BY ALL")(
    lambda a: score.compare_findings(a.findings.where("finding_type <> 'deprecated_input'"), a.findings.where("finding_type <> 'target_leakage'"))
)
