"""Access to VARIANT records where a missing field differs from a JSON null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(record: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(record, f"$.{path}", as_type)


def has_field(record: Column, path: str) -> Column:
    """True for a present field, JSON null included."""
    return field(record, path).isNotNull()


def type_name(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(type_name(value).startswith("OBJECT"), F.lit(False))


def is_number(value: Column) -> Column:
    return F.coalesce(type_name(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def is_json_null(value: Column) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(False))


def kept(*messages: Column) -> Column:
    """List of the messages that apply (each a CASE without ELSE)."""
    return F.array_compact(F.array(*messages))
