"""Column expressions over URNs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_FIELD = r"^urn:li:schemaField:\((urn:li:dataset:\(.*?\)),(.+)\)$"
DATASET = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),(.+),([^,]+)\)$"
MODEL = r"^urn:li:mlModel:\([^,]+,(.+),[^,]+\)$"


def _part(column: Column | str, pattern: str, group: int) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def entity_type(urn: Column | str) -> Column:
    """Third part of a URN; null when there is none."""
    return F.get(F.split(urn, ":"), F.lit(2))


def field_parent(urn: Column | str) -> Column:
    """Dataset of a column; null when the URN is not a well-formed column."""
    return _part(urn, SCHEMA_FIELD, 1)


def field_path(urn: Column | str) -> Column:
    return _part(urn, SCHEMA_FIELD, 2)


def dataset_platform(urn: Column | str) -> Column:
    return _part(urn, DATASET, 1)


def dataset_name(urn: Column | str) -> Column:
    return _part(urn, DATASET, 2)


def dataset_env(urn: Column | str) -> Column:
    return _part(urn, DATASET, 3)


def model_name(name: Column | str, urn: Column | str) -> Column:
    """The given name unless empty, else the name within the URN."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.nullif(name, F.lit("")), _part(urn, MODEL, 1))


def marker_name(urn: Column | str) -> Column:
    """What follows the last colon."""
    return F.substring_index(urn, ":", -1)


def touched_entity(urn: Column | str) -> Column:
    """Datasets and models themselves, columns by their dataset, anything else null."""
    kind = entity_type(urn)
    urn = F.col(urn) if isinstance(urn, str) else urn
    return F.when(kind.isin("dataset", "mlModel"), urn).when(kind == "schemaField", field_parent(urn))
