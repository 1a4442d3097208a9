"""Keep-first deduplication and key-based set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.joins import null_safe_join


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key in arrival order; missing key parts are equal.

    The ``row_number() = 1`` filter becomes a group limit that already runs
    before the shuffle, so a key with very many copies sends one row per task.
    """
    arrival = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(arrival)).where("_rn = 1").drop("_rn")


def not_in(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key does not occur in ``existing``."""
    return null_safe_join(new, existing.select(*keys), keys, "left_anti")


def first_seen(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` that are first of their key, in it and in the history."""
    return not_in(keep_first(new, keys, order), existing, keys)


def union_keep_first(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of several collections; on equal keys the earlier source wins."""
    ranked = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return keep_first(union, keys, ["_source", *order]).drop("_source")
