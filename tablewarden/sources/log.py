"""Change-log rows, event tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLACING = ["UPSERT", "CREATE", "RESTATE"]


def decode_change_events(log: DataFrame) -> DataFrame:
    """Rows with an entity and an aspect name; `aspect` is the payload as a map, empty when it cannot be parsed."""
    parsed = F.from_json("aspect_json", "map<string,string>", {"mode": "PERMISSIVE"})
    empty = F.create_map().cast("map<string,string>")
    return log.where("entity_urn is not null and aspect_name is not null").withColumn("aspect", F.coalesce(parsed, empty))


def aspect_snapshot(log: DataFrame, order: str = "seq") -> DataFrame:
    """Last whole write of each entity and aspect; partial writes are no replacement, and deleted ones are gone."""
    whole = log.where(F.col("entity_urn").isNotNull() & F.col("aspect_name").isNotNull() & F.col("change_type").isin(*REPLACING, "DELETE"))
    last = whole.groupBy("entity_urn", "aspect_name").agg(F.max_by(F.struct("change_type", "aspect_json", order), order).alias("last"))
    return last.where("last.change_type <> 'DELETE'").select("entity_urn", "aspect_name", "last.change_type", "last.aspect_json", f"last.{order}")


def latest_operation(operations: DataFrame) -> DataFrame:
    """Latest reported change of each dataset; datasets without a usable one have no row."""
    known = operations.where("last_updated_ms is not null")
    return known.groupBy("dataset_urn").agg(F.max_by("last_updated_ms", F.struct("ts_ms", "last_updated_ms")).alias("last_updated_ms"), F.max("ts_ms").alias("ts_ms"))


def latest_assertion_result(runs: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("result_type", "lag_hours", "ts_ms"), "ts_ms").alias("last")
    return runs.groupBy("assertion_urn", "assertee_urn").agg(latest).select("assertion_urn", "assertee_urn", "last.*")


def dbt_features(manifests: DataFrame) -> DataFrame:
    """Declared features of manifests (path, json): semantic models' dimensions and measures with a plain column.

    Computed expressions come out with computed = true and no column.
    """
    node = "struct<alias:string,schema_name:string>"
    entry = "array<struct<name:string,expr:string>>"
    schema = f"struct<semantic_models:map<string,struct<name:string,node_relation:{node},entities:{entry},dimensions:{entry},measures:{entry}>>>"
    models = manifests.select("path", F.explode(F.from_json("json", schema)["semantic_models"]).alias("id", "m"))
    tagged = lambda part: F.transform(F.coalesce(F.col(f"m.{part}"), F.array().cast(entry)), lambda x: F.struct(F.lit(part).alias("part"), x["name"].alias("name"), F.coalesce(F.nullif(x["expr"], F.lit("")), x["name"]).alias("column")))
    table = F.concat_ws(".", "m.node_relation.schema_name", "m.node_relation.alias").alias("source_table")
    rows = models.select("path", F.col("m.name").alias("semantic_model"), table, F.explode(F.concat(*[tagged(p) for p in ("entities", "dimensions", "measures")])).alias("e"))
    plain = F.rlike("e.column", F.lit("^[A-Za-z_][A-Za-z0-9_]*$"))
    return rows.select("path", "semantic_model", "source_table", "e.part", "e.name", F.when(plain, F.col("e.column")).alias("column"), (~plain).alias("computed"))


def registry_features(views: DataFrame) -> DataFrame:
    """Features of feature views (view, source_table, join_keys, field_mapping, columns): a mapped feature reads the column
    that maps to it, any other its own name; join keys are no features."""
    features = views.select("view", "source_table", F.col("field_mapping").alias("map"), F.explode(F.array_except("columns", "join_keys")).alias("feature"))
    back = F.map_from_entries(F.transform(F.map_entries("map"), lambda e: F.struct(e["value"], e["key"])))
    return features.select("view", "source_table", "feature", F.coalesce(F.try_element_at(back, F.col("feature")), F.col("feature")).alias("column"))


def label_views(views: DataFrame) -> DataFrame:
    """(view, label): views that hold one column besides their join keys."""
    left = views.select("view", F.array_except("columns", "join_keys").alias("rest"))
    return left.where(F.size("rest") == 1).select("view", F.get("rest", F.lit(0)).alias("label"))


def load_raw_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; names in lower case; types inferred unless given."""
    reader = spark.read.option("header", True)
    frame = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return frame.toDF(*[c.lower() for c in frame.columns])


def change_log_stream(spark: SparkSession, source: str, schema: str | None = None, **options: str) -> DataFrame:
    """Stream of the change topic from its end on, or of files under a path."""
    if source.startswith("kafka:"):
        return spark.readStream.format("kafka").options(subscribe=source[6:], startingOffsets="latest", **options).load()
    return spark.readStream.schema(schema).options(**options).parquet(source)
