"""What is said about findings: warnings, evidence, remedies, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def radius_warnings(radii: DataFrame, reached: DataFrame, cap: int, hops: int) -> DataFrame:
    """(resource_urn, warning) of stale tables: whether no model was reached, and whether the walk may have been cut."""
    full = reached.groupBy("root").agg((F.count(F.lit(1)) >= cap).alias("full")).withColumnRenamed("root", "resource_urn")
    cut_off = F.coalesce("full", F.lit(False))
    text = F.when((F.col("n_models") == 0) & cut_off, "unknown").when(F.col("n_models") == 0, f"none within {hops} hops").when(cut_off, "more may be affected")
    return radii.join(full, "resource_urn", "left").select("resource_urn", text.alias("warning"))
