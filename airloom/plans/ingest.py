"""Incremental ingest: bookmarks, late data, deduplication against history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom import schema
from airloom.operators.aggregates import high_watermarks
from airloom.operators.dedup import keep_first, not_in
from airloom.operators.joins import null_safe_join, staged_join
from airloom.session import stage
from airloom.sources import landed
from airloom.sources.rollup import Rollup
from airloom.sources.store import PARTITIONS, MeasurementStore, with_month

STATE_KEY = ["location_id", "parameter"]


def since_bookmark(records: DataFrame, state: DataFrame, lateness: str = "0 seconds", ts: str = "datetime_utc", keys: list[str] | None = None) -> DataFrame:
    """Records at or after their key's bookmark; keys without one are loaded whole.

    ``lateness`` reaches behind the bookmark for sensors that lag. The overlap
    costs nothing: deduplication drops what is already there.
    """
    keys = keys or STATE_KEY
    marks = state.groupBy(*keys).agg(F.max("last_fetch_time").alias("_mark"))
    joined = staged_join(records, marks, keys, "left")
    reached = F.col("_mark").isNull() | (F.col(ts) >= F.col("_mark") - F.expr(f"INTERVAL {lateness}"))
    return joined.where(reached).drop("_mark")


def touched_by(batch: DataFrame) -> DataFrame:
    """The (location, month) pairs of the batch, with their row counts ``n``."""
    return stage(with_month(batch).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n")), "touched_partitions")


def touched_history(history: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of the store's partitions that a batch can collide with.

    Nothing is collected: the join prunes partitions while it runs, and months
    outside the batch's span are cut off by two scalar subqueries even where
    the pairs are too many to be broadcast. Rows without location or month lie
    in partitions of their own and are always read.
    """
    month = F.col("event_month")
    first, last = (touched.agg(f("event_month")).scalar() for f in (F.min, F.max))
    # the comparison tells the planner that this side selects; it lets every pair through
    pairs = touched.where("n > 0").select(*PARTITIONS)
    known = history.where(month.between(first, last)).join(pairs, PARTITIONS, "left_semi")
    return known.unionByName(history.where(F.col("location_id").isNull() | month.isNull()))


def records_of(history: DataFrame, locations: DataFrame) -> DataFrame:
    """All rows of the locations given as ``(location_id, n)``; other locations are not opened."""
    wanted = locations.where("n >= 0").select("location_id")
    known = history.join(wanted, "location_id", "left_semi")
    missing = locations.where("location_id IS NULL").select("location_id")
    return known.unionByName(null_safe_join(history.where("location_id IS NULL"), missing, ["location_id"], "left_semi"))


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("location_id").agg(F.count(F.lit(1)).alias(name))


def _stats(counts: list[DataFrame]) -> DataFrame:
    """Counts per location from frames that each hold one or more of the counters."""
    rows = counts[0]
    for part in counts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    names = ["fetched", "new", "total", "rejected"]
    missing = {n: F.lit(None).cast("long") for n in names if n not in rows.columns}
    totals = rows.withColumns(missing).groupBy("location_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    failed = (F.col("rejected") > 0) & (F.col("fetched") == 0)
    return totals.select(
        "location_id", F.col("fetched").alias("fetched_records"), F.col("new").alias("new_records"),
        (F.col("fetched") - F.col("new")).alias("duplicates_removed"), F.col("total").alias("total_records"),
        F.when(failed, "error").otherwise("success").alias("status"),
    )


def location_stats(
    fetched: DataFrame, new: DataFrame, history: DataFrame, rejected: DataFrame | None = None, configured: DataFrame | None = None
) -> DataFrame:
    """Fetched, new, duplicate and total records and a status per location.

    A location fails when it had rejected records and no usable one; it does
    not stop the others. Each ``configured`` location has a row, a silent one too.
    """
    added = _count(new, "new").withColumn("total", F.col("new"))
    counts = [_count(fetched, "fetched"), added, _count(history, "total")]
    if rejected is not None:
        counts.append(_count(rejected, "rejected"))
    if configured is not None:
        counts.append(configured.select("location_id"))
    return _stats(counts)


def run_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("total_locations"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.coalesce(F.sum("new_records"), F.lit(0)).alias("total_new_records"),
    )


def next_state(fetched: DataFrame, new_counts: DataFrame, run_time: str) -> DataFrame:
    """Bookmark rows to upsert: only keys that were fetched move.

    ``new_counts`` holds (location_id, parameter, new). Only duplicates count
    as fetched, too: the time stays, the count becomes 0.
    """
    marks = high_watermarks(fetched, tuple(STATE_KEY))
    rows = null_safe_join(marks, new_counts.select(*STATE_KEY, "new"), STATE_KEY, "left")
    return rows.select(
        *STATE_KEY, "last_fetch_time",
        F.coalesce("new", F.lit(0)).cast("long").alias("last_records_count"),
        F.lit(run_time).cast("timestamp_ntz").alias("last_successful_run"),
    )


def new_counts(new: DataFrame) -> DataFrame:
    return new.groupBy(*STATE_KEY).agg(F.count(F.lit(1)).alias("new"))


def ingest(
    store: MeasurementStore, fetched: DataFrame, run_time: str, order: list[str],
    keys: list[str] | None = None, with_stats: bool = True, configured: DataFrame | None = None, rollup: Rollup | None = None,
) -> DataFrame | None:
    """Append what is new, move the bookmarks, return statistics per location.

    The batch is read from its source once. New rows go straight to the store,
    marked with the run, and are counted there. Safe to run again with the
    same batch: the second run finds only duplicates. Rows with a
    ``reject_reason`` go to the store's quarantine and into the statistics,
    which list the locations of the batch and those ``configured``. A
    ``rollup`` gets the run's partial aggregates; what an earlier, crashed run
    left out is added first.
    """
    keys = keys or schema.INGEST_KEY
    if rollup:
        rollup.catch_up()
    run = uuid.uuid4().hex
    fetched, failed = stage(fetched, "fetched"), []
    if "reject_reason" in fetched.columns:
        bad, fetched = landed.rejected(fetched), landed.accepted(fetched)
        store.quarantine(bad.withColumn("ingest_run", F.lit(run)))
        failed = [_count(bad, "rejected")]
    touched = touched_by(fetched)
    new = not_in(keep_first(fetched, keys, order), touched_history(store.read(), touched), keys)
    if rollup:
        rollup.begin(run)
    store.append(new.withColumn("ingest_run", F.lit(run)))
    if rollup:
        rollup.add(run, touched_history(store.read(), touched))
    added = stage(new_counts(touched_history(store.read(), touched).where(F.col("ingest_run") == run)), "new_counts")
    store.write_state(next_state(fetched, added, run_time))
    if not with_stats:
        return None
    by_location = added.groupBy("location_id").agg(F.sum("new").alias("new"))
    listed = touched.select("location_id", "n")
    for more in failed + ([] if configured is None else [configured]):
        listed = listed.unionByName(more.select("location_id", F.lit(0).cast("long").alias("n")))
    listed = stage(listed.groupBy("location_id").agg(F.sum("n").alias("n")), "locations")
    # location_id is a partition column, so the total reads file footers only, of these locations
    total = _count(records_of(store.read(), listed), "total")
    return stage(_stats([_count(fetched, "fetched"), by_location, total, *failed, listed.select("location_id")]), "ingest_stats")
