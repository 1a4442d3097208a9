"""Joins on keys that may be missing, and lookups of small sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.text import location_label
from airloom.session import stage


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key part equals another missing one.

    Spark still plans it as a hash or sort-merge join. Columns other than the
    keys must differ between the two sides.
    """
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = F.expr(" AND ".join(f"`{c}` <=> `_right_{c}`" for c in on))
    return left.join(right, same, how).drop(*[f"_right_{c}" for c in on])


def staged_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join rows with an aggregate that is normally small.

    The aggregate is written out first, so the choice between broadcast and
    shuffle rests on its real size and not on a guess.
    """
    return null_safe_join(rows, stage(side, "side"), on, how)


def with_location_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Lookup of (location_id, location_name) with a label for unnamed ids."""
    names = names.select("location_id", F.col("location_name").alias("_name"))
    return (
        df.join(names, "location_id", "left")
        .withColumn("location_name", location_label(F.col("location_id"), F.col("_name")))
        .drop("_name")
    )
