"""Merge of overlapping collections: deduplicate, order by time, keep the previous version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom import schema
from airloom.operators.aggregates import first_and_last
from airloom.operators.dedup import union_keep_first
from airloom.operators.joins import null_safe_join
from airloom.sources.store import write_version

COUNTERS = ["before", "duplicates", "after"]


def merge(sources: list[DataFrame], keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    return union_keep_first(sources, keys or schema.MERGE_KEY, order or ["seq"])


def in_time_order(df: DataFrame) -> DataFrame:
    """Time order inside each task; a record without a time comes first, ties by arrival."""
    return df.sortWithinPartitions("location_id", F.col("datetime_utc").asc_nulls_first(), "seq")


def merge_summary(before: DataFrame, merged: DataFrame) -> DataFrame:
    """Per location: records before and after, duplicates, local date range."""
    n = F.count(F.lit(1))
    counts = null_safe_join(
        before.groupBy("location_id").agg(n.alias("before")),
        merged.groupBy("location_id").agg(n.alias("after")),
        ["location_id"],
    )
    rows = null_safe_join(counts, first_and_last(merged), ["location_id"])
    return rows.withColumn("duplicates", F.col("before") - F.col("after"))


def merge_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def save_merged(merged: DataFrame, path: str) -> int:
    """New version in time order; the one before it is the backup."""
    spread = merged.hint("rebalance", "location_id")
    return write_version(in_time_order(spread), path)
