"""Text columns: keys, labels and number formats of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airloom import fixed_values as fixed


def joined_key(*parts: Column) -> Column:
    """Parts joined with ``_``; a missing part counts as an empty one."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def location_label(location_id: Column, name: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit(fixed.LOCATION_LABEL), location_id.cast("string")))


def location_id_from_path(path: Column) -> Column:
    return F.nullif(
        F.regexp_extract(path, r"location_(?:id=)?(\d+)", 1), F.lit("")
    ).cast("long")


def sorted_names(names: Column) -> Column:
    """Distinct names of a collected set as one ``a, b, c`` text."""
    return F.array_join(F.array_sort(names), ", ")


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def decimals(number: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", number)
