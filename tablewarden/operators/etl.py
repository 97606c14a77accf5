"""The data that the checks are about: staging, features, labels and a training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stg_customers(raw: DataFrame) -> DataFrame:
    """Clean types; a tenure of 0 and blank totals are unknown."""
    return raw.select("customer_id", F.nullif("tenure", F.lit(0)).alias("tenure_months"), F.col("monthly").cast("double").alias("monthly_charges"), F.nullif(F.trim("total"), F.lit("")).try_cast("double").alias("total_charges"), "contract", "churn")


def customer_features(staged: DataFrame) -> DataFrame:
    """Features; `is_retained` leaks the label."""
    return staged.select("customer_id", "tenure_months", "monthly_charges", "total_charges", F.when(F.col("contract") == "monthly", 1).otherwise(0).alias("is_monthly"), F.when(F.col("churn") == "No", 1).otherwise(0).alias("is_retained"))


def customer_labels(staged: DataFrame) -> DataFrame:
    return staged.select("customer_id", F.when(F.col("churn") == "Yes", 1).otherwise(0).alias("churned"))


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """A row for each day from start up to, without, end."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1))).alias("date_day"))


def training_set(features: DataFrame, labels: DataFrame, test_share: int = 20) -> DataFrame:
    """Complete rows with their label and a split by hash of the id."""
    rows = features.join(labels, "customer_id").dropna()
    return rows.withColumn("split", F.when(F.pmod(F.crc32(F.col("customer_id").cast("string").cast("binary")), F.lit(100)) < test_share, "test").otherwise("train"))
