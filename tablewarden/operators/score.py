"""Findings as one table, trust scores, gates and histories of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WEIGHTS
from ..functions import rules

#: Incident type of each finding type.
INCIDENT_TYPES = {"upstream_freshness": "FRESHNESS", "target_leakage": "FIELD", "sensitive_source": "FIELD", "proxy_candidate": "FIELD", "input_schema_drift": "DATA_SCHEMA", "deprecated_input": "OPERATIONAL", "table_level_risk": "OPERATIONAL"}
SCORED = {"upstream_freshness": "upstream_failure", "target_leakage": "leakage", "input_schema_drift": "schema_drift", "sensitive_source": "sensitive_source", "deprecated_input": "deprecated_input"}


def incident_type() -> Column:
    kind = reduce(lambda c, kv: F.when(F.col("finding_type") == kv[0], kv[1]).otherwise(c), INCIDENT_TYPES.items(), F.lit(None).cast("string"))
    return F.when((F.col("finding_type") == "table_level_risk") & F.startswith("title", F.lit("Table-level stale ")), "FRESHNESS").otherwise(kind)


def model_findings(radii: DataFrame, *parts: DataFrame) -> DataFrame:
    """(finding_type, model_urn, resource_urn, title, severity, severity_rank, incident_type, lag_ratio): a row for each finding and model.

    A stale table counts for every model that it reaches.
    """
    columns = ["finding_type", "model_urn", "resource_urn", "title", "severity", "lag_ratio"]
    fresh = radii.withColumn("model_urn", F.explode("models")).withColumn("lag_ratio", F.least(F.col("lag_hours") / F.col("sla_hours"), F.lit(1.0)))
    rows = reduce(DataFrame.unionByName, [p.withColumn("lag_ratio", F.lit(None).cast("double")).select(*columns) for p in parts], fresh.select(*columns))
    return rows.withColumn("severity_rank", rules.severity_rank("severity")).withColumn("incident_type", incident_type())


def trust_inputs(findings: DataFrame, refs: DataFrame) -> DataFrame:
    """A row for each model with a scored finding: a flag and first cause by kind, worst severity, greatest lag ratio.

    Proxy and table-level findings are questions, so they count for nothing here. The first cause is by severity, then title.
    """
    scored = findings.where(F.col("finding_type").isin(*SCORED))
    flags = [F.max(F.col("finding_type") == kind).alias(name) for kind, name in SCORED.items()]
    causes = [F.min_by(F.when(F.col("finding_type") == kind, F.col("title")), F.when(F.col("finding_type") == kind, F.struct("severity_rank", "title"))).alias(f"{name}_cause") for kind, name in SCORED.items()]
    rows = scored.groupBy("model_urn").agg(*flags, *causes, F.min("severity_rank").alias("worst"), F.coalesce(F.max("lag_ratio"), F.lit(0.0)).alias("lag_ratio"))
    return rows.join(refs.select("model_urn", "name", "has_owner"), "model_urn").withColumn("missing_owner", ~F.col("has_owner"))


def trust_scores(inputs: DataFrame, weights: dict[str, float] = WEIGHTS, healthy: int = 70, watch: int = 40) -> DataFrame:
    """(model_urn, score, band, deductions): 100 less the weights, rounded half to even within 0..100.

    Deductions are the worst first, then by name. A critical or high finding caps a healthy band to watch.
    """
    points = [(n, F.when(F.col(n), F.lit(float(w))).otherwise(0.0)) for n, w in weights.items() if n != "freshness_lag"]
    points.append(("freshness_lag", F.col("lag_ratio") * float(weights["freshness_lag"])))
    listed = F.filter(F.array(*[F.struct((-p).alias("neg"), F.lit(n).alias("name")) for n, p in points]), lambda x: x["neg"] < 0)
    total = sum((p for _, p in points), F.lit(0.0))
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - total)), 0).cast("int")
    band = F.when((F.col("score") >= healthy) & ~F.col("worst").isin(0, 1), "healthy").when(F.col("score") >= watch, "watch").otherwise("at_risk")
    rows = inputs.withColumn("score", score).withColumn("band", band)
    return rows.withColumn("deductions", F.transform(F.array_sort(listed), lambda x: F.struct(x["name"].alias("name"), (-x["neg"]).alias("points"))))


def points(counts: DataFrame, refs: DataFrame, sla_hours: float) -> DataFrame:
    """(model_urn, score): the scores of trust_scores() from counts of findings, (model_urn, finding_type, n, lag_hours)."""
    flags = [F.max(F.col("finding_type") == kind).alias(name) for kind, name in SCORED.items()]
    ratio = F.when(F.col("lag_hours").isNotNull(), F.least(F.col("lag_hours") / F.lit(sla_hours), F.lit(1.0)))
    rows = counts.where(F.col("finding_type").isin(*SCORED)).groupBy("model_urn").agg(*flags, F.lit(None).cast("int").alias("worst"), F.coalesce(F.max(ratio), F.lit(0.0)).alias("lag_ratio"))
    rows = rows.join(refs.select("model_urn", (~F.col("has_owner")).alias("missing_owner")), "model_urn")
    return trust_scores(rows).select("model_urn", "score")


def waterfall(scores: DataFrame) -> DataFrame:
    """Lines that lead from 100 to the score, amounts right-aligned."""
    lines = F.transform("deductions", lambda d: F.concat(F.lpad(F.format_string("-%.0f", d["points"]), 5, " "), F.lit("  "), d["name"]))
    all_lines = F.concat(F.array(F.lit("  100  starting")), lines, F.array(F.lit("-----")), F.array(F.concat(F.lpad(F.col("score").cast("string"), 5, " "), F.lit("  "), "band")))
    return scores.select("model_urn", all_lines.alias("lines"))


def gate_violations(findings: DataFrame, scores: DataFrame, worst: str | None, least_score: int | None) -> DataFrame:
    """(model_urn, rule, detail): findings at or above a severity, and models strictly below a score. No rule, no rows."""
    empty = findings.limit(0).select("model_urn", F.lit("").alias("rule"), F.col("title").alias("detail"))
    if worst is not None:
        hit = findings.where(F.col("severity_rank") <= rules.SEVERITIES.index(worst))
        empty = empty.unionByName(hit.select("model_urn", F.lit("severity").alias("rule"), F.concat("severity", F.lit(": "), "title").alias("detail")))
    if least_score is not None:
        low = scores.where(F.col("score") < least_score)
        empty = empty.unionByName(low.select("model_urn", F.lit("trust").alias("rule"), F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(f" below {least_score}")).alias("detail")))
    return empty


def policy_caution(worst: str | None, least_score: int | None) -> str | None:
    """What to say of a policy that blocks by score alone: its points are weights that nobody measured, a severity is what a check found."""
    if least_score is None or worst is not None:
        return None
    return "blocks by trust score alone: a sum of chosen weights without a unit; set a severity to block on what a check decided"


def gate_verdict(models: DataFrame, violations: DataFrame, findings: DataFrame, enforced: bool = True) -> DataFrame:
    """A verdict for every model: blocked, exit code, violations and findings seen."""
    v = violations.groupBy("model_urn").agg(F.count(F.lit(1)).alias("violations"))
    f = findings.groupBy("model_urn").agg(F.count(F.lit(1)).alias("findings_seen"))
    rows = models.select("model_urn").join(v, "model_urn", "left").join(f, "model_urn", "left").na.fill(0, ["violations", "findings_seen"])
    return rows.select("model_urn", "violations", "findings_seen", F.lit(enforced).alias("enforced"), ((F.col("violations") > 0) & enforced).alias("blocked"), F.when((F.col("violations") > 0) & enforced, 1).otherwise(0).alias("exit_code"))


def ci_annotations(violations: DataFrame) -> DataFrame:
    """A CI error line for each violation; a line break in the title is a space, in the message %0A."""
    title = F.regexp_replace(F.concat("rule", F.lit(" "), "model_urn"), r"[\r\n]+", " ")
    return violations.select("model_urn", F.concat(F.lit("::error title="), title, F.lit("::"), F.regexp_replace("detail", "\r?\n", "%0A")).alias("line"))


def inventory(models: DataFrame, findings: DataFrame, linked: DataFrame) -> DataFrame:
    """(model_urn, findings, worst, status) of every model: table level only, findings, clean, or not checked."""
    f = findings.groupBy("model_urn").agg(F.count(F.lit(1)).alias("findings"), F.min("severity_rank").alias("rank"), F.min(F.col("finding_type") == "table_level_risk").alias("coarse"))
    known = linked.select("model_urn").distinct().withColumn("checked", F.lit(True))
    rows = models.select("model_urn").join(f, "model_urn", "left").join(known, "model_urn", "left")
    status = F.when(F.col("coarse"), "table level only").when(F.col("findings") > 0, "findings").when(F.col("checked"), "clean").otherwise("not checked")
    worst = F.get(F.array(*[F.lit(s) for s in rules.SEVERITIES]), F.col("rank"))
    return rows.select("model_urn", F.coalesce("findings", F.lit(0)).alias("findings"), worst.alias("worst"), status.alias("status"))


def signature(findings: DataFrame) -> DataFrame:
    """(model_urn, n, signature): the set of findings of a model as one hash; equal sets have equal hashes."""
    key = F.struct("finding_type", "resource_urn", "title", "severity")
    return findings.groupBy("model_urn").agg(F.array_sort(F.collect_set(key)).alias("s")).select("model_urn", F.size("s").alias("n"), F.xxhash64("s").alias("signature"))


def compare_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key columns, state): findings that are new, recovered or unchanged."""
    keys = ["finding_type", "model_urn", "resource_urn", "title"]
    a = before.select(*keys).distinct().withColumn("b", F.lit(1))
    b = after.select(*keys).distinct().withColumn("a", F.lit(1))
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "recovered").otherwise("unchanged")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def top_findings(findings: DataFrame, keep: int = 20) -> DataFrame:
    """First `keep` findings of each model, worst first, and how many more there are."""
    by = Window.partitionBy("model_urn")
    place = F.row_number().over(by.orderBy("severity_rank", "finding_type", "resource_urn", "title"))
    return findings.withColumn("place", place).withColumn("more", F.greatest(F.lit(0), F.count(F.lit(1)).over(by) - keep)).where(F.col("place") <= keep)


def risk_flags(existing: DataFrame, current: DataFrame, recovered: DataFrame) -> DataFrame:
    """(model_urn, flags, cleared): existing and current types less those that recovered and did not come again."""
    rows = existing.join(current, "model_urn", "full_outer").join(recovered, "model_urn", "left")
    none = F.array().cast("array<string>")
    now, was, gone = (F.coalesce(c, none) for c in ("current", "existing", "recovered"))
    cleared = F.array_except(gone, now)
    return rows.select("model_urn", F.array_sort(F.array_except(F.array_union(was, now), cleared)).alias("flags"), F.array_sort(F.array_intersect(was, cleared)).alias("cleared"))
