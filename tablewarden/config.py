"""Thresholds and mark sets of the checks."""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


@dataclass(frozen=True)
class Config:
    """Defaults of all checks. Empty mark sets mean that the check is not run, never that it found nothing."""

    now_ms: int
    sla_hours: float = 6.0
    downstream_hops: int = 3
    leakage_hops: int = 6
    proxy_hops: int = 3
    lineage_result_cap: int = 500
    unused_idle_days: float = 90.0
    history_length: int = 20
    entity_cap: int = 200
    label_term: str = ""
    sensitive: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    healthy_at: int = 70
    watch_at: int = 40


#: Points that a trust score loses.
WEIGHTS = {"upstream_failure": 40.0, "leakage": 20.0, "schema_drift": 15.0, "freshness_lag": 15.0, "sensitive_source": 15.0, "missing_owner": 10.0, "deprecated_input": 5.0}
