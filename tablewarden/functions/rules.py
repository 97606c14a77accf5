"""Column expressions for freshness, severity and idleness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAY_MS, HOUR_MS

#: Severities from worst to least.
SEVERITIES = ["critical", "high", "medium", "low"]


def lag_hours(last_ms: Column | str, now_ms: int) -> Column:
    last_ms = F.col(last_ms) if isinstance(last_ms, str) else last_ms
    return (F.lit(now_ms) - last_ms) / float(HOUR_MS)


def is_stale(last_ms: Column | str, now_ms: int, sla_hours: float) -> Column:
    """Strictly beyond the limit; unknown stays null."""
    return lag_hours(last_ms, now_ms) > sla_hours


def severity_rank(severity: Column | str) -> Column:
    out, severity = F.lit(None).cast("int"), F.col(severity) if isinstance(severity, str) else severity
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def severity(finding_type: Column | str, live: Column | str) -> Column:
    """Severity of a finding about one model, by its type and whether the model serves traffic."""
    kind, live = (F.col(c) if isinstance(c, str) else c for c in (finding_type, live))
    pick = lambda a, b: F.when(live, a).otherwise(b)
    return (
        F.when(kind == "target_leakage", pick("critical", "high"))
        .when(kind.isin("input_schema_drift", "sensitive_source"), pick("high", "medium"))
        .when(kind.isin("deprecated_input", "table_level_risk"), pick("medium", "low"))
        .when(kind == "proxy_candidate", "medium")
    )


def radius_severity(live: Column, deployed: Column) -> Column:
    """Severity of a model that a stale table reaches."""
    return F.when(live, "critical").when(deployed, "high").otherwise("medium")


def last_touched(*stamps: str) -> Column:
    """Latest stamp; null only when all are."""
    return F.greatest(*[F.col(s) for s in stamps])


def idle_days(touched_ms: Column | str, now_ms: int) -> Column:
    touched_ms = F.col(touched_ms) if isinstance(touched_ms, str) else touched_ms
    return F.when(touched_ms.isNotNull(), F.greatest(F.lit(now_ms) - touched_ms, F.lit(0)) / float(DAY_MS))
