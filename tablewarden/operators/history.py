"""Score and coverage histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_trust_entry(raw: Column | str) -> Column:
    """Struct of a line ts|run|score|band|names|version (version may be missing); null when the score is no integer."""
    p = F.split(raw, r"\|")
    score = F.get(p, F.lit(2)).try_cast("int")
    made = F.struct(F.get(p, F.lit(0)).try_cast("long").alias("recorded_at"), F.get(p, F.lit(1)).alias("run_id"), score.alias("score"), F.get(p, F.lit(3)).alias("band"), F.split(F.get(p, F.lit(4)), ",").alias("names"), F.coalesce(F.get(p, F.lit(5)), F.lit("")).alias("version"))
    return F.when(F.size(p).isin(5, 6) & score.isNotNull(), made)


def render_trust_entry() -> Column:
    return F.concat_ws("|", F.col("recorded_at").cast("string"), "run_id", F.col("score").cast("string"), "band", F.array_join("names", ","), "version")


def capped_history(entries: DataFrame, keep: int = 20) -> DataFrame:
    """Last `keep` entries of each model by time; of a run only its newest entry counts."""
    once = entries.groupBy("model_urn", "run_id").agg(F.max_by(F.struct(*[c for c in entries.columns if c not in ("model_urn", "run_id")]), "recorded_at").alias("e")).select("model_urn", "run_id", "e.*")
    newest = Window.partitionBy("model_urn").orderBy(F.desc("recorded_at"), F.desc("run_id"))
    return once.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= keep)


def with_previous(entries: DataFrame) -> DataFrame:
    """Add the score before and whether the trend breaks, because the scoring changed."""
    order = Window.partitionBy("model_urn").orderBy("recorded_at", "run_id")
    before = F.lag("version").over(order)
    broken = before.isNotNull() & (before != F.col("version"))
    return entries.withColumn("previous_score", F.lag("score").over(order)).withColumn("trend_break", broken)


def streaks(polls: DataFrame, value: str, key: str = "target", order: str = "at") -> DataFrame:
    """Add `streak`: how many polls in a row up to this one have had the same value (null is a value)."""
    by = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.row_number().over(by) == 1, 1).when(F.lag(value).over(by).eqNullSafe(F.col(value)), 0).otherwise(1)
    grouped = polls.withColumn("_c", changed).withColumn("_g", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_g").orderBy(order))).drop("_c", "_g")
