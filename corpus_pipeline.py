"""The corpus pipeline: each stage applies one operator to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm import jaccard, lines, mixing, packing, quality
from tablewarden.llm.common import discard, save

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", lines.stage),
    ("jaccard join", jaccard.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again for the next, which takes its place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
