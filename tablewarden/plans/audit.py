"""The model audit as one object: every intermediate of the catalog-wide checks, made once when asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import columns, models, tables, tally, walk
from ..operators.steps import cut
from ..sources import log
from .fixture import AGE, GENDER, LABEL, NOW_MS, PII, SECRET, Fixture
from .scalars import SLA


class Audit:
    """Checks over a catalog; attributes are DataFrames. What several checks start from is checkpointed once."""

    #: Marks of classified columns.
    CLASSES = (PII, SECRET, AGE, GENDER)

    def __init__(self, catalog: Fixture, now_ms: int = NOW_MS, sla_hours: float = SLA, hops: int = 3, column_hops: int = 6) -> None:
        self.t, self.now_ms, self.sla, self.hops, self.column_hops = catalog, now_ms, sla_hours, hops, column_hops

    @cached_property
    def refs(self) -> DataFrame:
        return cut(models.model_refs(self.t.models, self.t.model_deployments, self.t.deployments, self.t.owners))

    @cached_property
    def linked(self) -> DataFrame:
        return cut(models.linked_features(self.t.model_features, self.t.features))

    @cached_property
    def sources(self) -> DataFrame:
        return cut(self.linked.select(F.col("source").alias("column_urn")).distinct())

    def marks(self, *markers: str) -> DataFrame:
        return models.column_markers(self.t.column_marks, *markers)

    @cached_property
    def label_matches(self) -> DataFrame:
        return cut(walk.marked_ancestors(self.sources, self.t.column_lineage, self.marks(LABEL), self.column_hops))

    @cached_property
    def class_matches(self) -> DataFrame:
        return cut(walk.marked_ancestors(self.sources, self.t.column_lineage, self.marks(*self.CLASSES), self.column_hops))

    @cached_property
    def limits(self) -> DataFrame:
        return walk.walk_limits(self.sources, self.t.column_lineage, self.column_hops, 500)

    @cached_property
    def below(self) -> DataFrame:
        """Columns with a match among labels ('label') and among classified columns ('class'), without the matches."""
        return walk.below({"label": self.marks(LABEL), "class": self.marks(*self.CLASSES)}, self.t.column_lineage, self.column_hops)

    @cached_property
    def shared(self) -> DataFrame:
        classified = self.below.where("root = 'class'")
        return cut(columns.shared_protected(self.t.column_lineage, self.marks(AGE, GENDER), classified, 3, self.column_hops))

    @cached_property
    def feature_tally(self) -> DataFrame:
        sources = models.source_columns(self.t.features).select(F.col("source").alias("column_urn"))
        limits = walk.limited(sources, self.t.column_lineage, self.column_hops, 500)
        return cut(tally.of_features(self.t.model_features, self.t.features, tally.of_columns(self.below, self.shared, limits)))

    @cached_property
    def check_tally(self) -> DataFrame:
        """(model_urn, finding_type, n): findings of the checks that may leave a gap."""
        t, rows = self.t, self.feature_tally
        parts = {
            "target_leakage": rows.select("model_urn", F.col("leaks").alias("n")),
            "sensitive_source": rows.select("model_urn", F.col("exposures").alias("n")),
            "proxy_candidate": tally.proxies(t.model_features, t.features, self.shared),
            "input_schema_drift": tally.drifts(t.model_runs, t.run_inputs, t.training_snapshots, t.training_schema, t.schema_fields),
            "deprecated_input": self.inputs.join(t.deprecations.where("deprecated").select(F.col("entity_urn").alias("dataset_urn")), "dataset_urn").groupBy("model_urn").agg(F.count(F.lit(1)).alias("n")),
        }
        return cut(tally.found(parts, t.models))

    @cached_property
    def leaks(self) -> DataFrame:
        return columns.derived_features(self.linked, self.refs, self.label_matches, "target_leakage")

    @cached_property
    def exposures(self) -> DataFrame:
        return columns.derived_features(self.linked, self.refs, self.class_matches, "sensitive_source")

    @cached_property
    def proxies(self) -> DataFrame:
        return columns.proxy_candidates(self.linked, self.refs, self.t.column_lineage, self.marks(AGE, GENDER), self.class_matches, 3)

    @cached_property
    def inputs(self) -> DataFrame:
        return models.model_inputs(self.t.model_runs, self.t.run_inputs)

    @cached_property
    def changes(self) -> DataFrame:
        return tables.schema_changes(self.t.model_runs, self.t.run_inputs, self.t.training_snapshots, self.t.training_schema, self.t.schema_fields)

    @cached_property
    def drifts(self) -> DataFrame:
        return tables.schema_drift(self.changes, self.refs)

    @cached_property
    def deprecated(self) -> DataFrame:
        return tables.deprecated_inputs(self.inputs, self.t.deprecations, self.refs)

    @cached_property
    def stale(self) -> DataFrame:
        return cut(tables.stale_tables(log.latest_operation(self.t.operations), self.now_ms, self.sla))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(models.lineage_edges(self.t.table_lineage, self.t.features, self.t.model_features))

    @cached_property
    def reached(self) -> DataFrame:
        return cut(tables.downstream_reach(self.stale, self.edges, self.hops))

    @cached_property
    def radius(self) -> DataFrame:
        return tables.radius_models(self.reached, self.refs, self.t.model_features)

    @cached_property
    def radii(self) -> DataFrame:
        return tables.blast_radius(self.stale, self.reached, self.radius, self.sla)

    @cached_property
    def training_tables(self) -> DataFrame:
        above = self.t.recorded_links.where("feature_dataset_urn is not null").select("model_urn", F.col("feature_dataset_urn").alias("dataset_urn"))
        return tables.training_tables(self.inputs, above)

    @cached_property
    def table_risks(self) -> DataFrame:
        return tables.table_level_risks(self.training_tables, self.linked, self.refs, self.stale, self.t.deprecations, self.marks(PII, SECRET))
