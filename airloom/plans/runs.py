"""Run log: metric roll-up, failure streaks and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom import schema
from airloom.functions import calendar

ALERT = ["timestamp", "level", "title", "message", "context"]


def run_metrics(runs: DataFrame) -> DataFrame:
    """Counters of each run, 0 where a run did not record one."""
    zero = F.lit(0.0)
    return runs.select(
        "run_id", "start_time", "end_time",
        *[F.coalesce(F.try_element_at("metrics", F.lit(c)), zero).alias(c) for c in fixed.RUN_COUNTERS],
        F.coalesce(F.size("errors"), F.lit(0)).cast("long").alias("total_errors"),
        calendar.seconds_between(F.col("start_time"), F.col("end_time")).alias("elapsed_seconds"),
    )


def run_row(stats: DataFrame, run_id: str, started: str, ended: str) -> DataFrame:
    """The run-log row of one ingest, from its statistics per location."""
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (started, ended))
    failed = F.col("status") == "error"
    sums = stats.agg(
        F.coalesce(F.sum("fetched_records"), F.lit(0)).alias("total_records_fetched"),
        F.coalesce(F.sum("duplicates_removed"), F.lit(0)).alias("total_records_deduplicated"),
        F.count(F.lit(1)).alias("total_locations_processed"),
        F.count_if(~failed).alias("successful_locations"), F.count_if(failed).alias("failed_locations"),
    ).withColumn("duration_seconds", calendar.seconds_between(start, end))
    metrics = F.create_map(*[part for c in fixed.RUN_COUNTERS for part in (F.lit(c), F.col(c).cast("double"))])
    return sums.select(
        F.lit(run_id).alias("run_id"), start.alias("start_time"), end.alias("end_time"), metrics.alias("metrics"),
        F.array().cast(schema.RUN["errors"].dataType).alias("errors"),
    )


def last_runs(runs: DataFrame, keep: int = fixed.RUNS_KEPT) -> DataFrame:
    return runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(keep)


def failure_streaks(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive failures up to each run; a success sets them back to 0.

    Needs ``run_id``, ``start_time`` and ``outcome`` (success, failed,
    exception). ``by`` names the columns of independent run histories; runs that
    start at the same time are ordered by id. Without ``by`` the log is one
    history, which one task goes through.
    """
    failed = (F.col("outcome") != "success").cast("long")
    order = ["start_time", "run_id"]
    history = Window.partitionBy(*by).orderBy(*order)
    island = F.sum(1 - failed).over(history.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        runs.withColumn("_island", island)
        .withColumn("streak", F.sum(failed).over(inside))
        .withColumn("recovered", (failed == 0) & F.coalesce(F.lag(failed).over(history) == 1, F.lit(False)))
        .drop("_island")
    )


def _alert(rows: DataFrame, at: Column, level: Column, title: Column, message: Column, *context: str) -> DataFrame:
    return rows.select(
        at.alias("timestamp"), level.alias("level"), title.alias("title"), message.alias("message"),
        F.to_json(F.struct(*context)).alias("context"),
    )


def streak_alerts(streaks: DataFrame, limit: int = fixed.MAX_CONSECUTIVE_FAILURES) -> DataFrame:
    """``error`` for a failed run, ``critical`` for a crashed one, from the limit on."""
    crashed = F.col("outcome") == "exception"
    times = F.col("streak").cast("string")
    message = F.when(crashed, F.concat(F.lit("Pipeline has failed "), times, F.lit(" times"))).otherwise(
        F.concat(F.lit("Pipeline has failed "), times, F.lit(" times consecutively"))
    )
    return _alert(
        streaks.where(F.col("streak") >= limit), F.col("start_time"),
        F.when(crashed, "critical").otherwise("error"),
        F.when(crashed, "Pipeline Critical Failure").otherwise("Pipeline Consecutive Failures"),
        message, "outcome", "streak",
    )


def recovery_events(streaks: DataFrame) -> DataFrame:
    return _alert(
        streaks.where("recovered"), F.col("start_time"), F.lit("info"), F.lit("Pipeline Recovered"),
        F.lit("Pipeline recovered from previous failures"), "outcome", "streak",
    )


def quality_alerts(metrics: DataFrame, at: str, least: float = fixed.MIN_QUALITY_SCORE) -> DataFrame:
    low = metrics.where(F.col("quality_score") < least)
    return _alert(
        low, F.lit(at).cast("timestamp_ntz"), F.lit("warning"),
        F.concat(F.lit("Low Data Quality: Location "), F.col("location_id").cast("string")),
        F.concat(F.lit("Data quality score: "), F.format_string("%.2f", "quality_score"), F.lit("%")),
        "location_id", "valid_records", "invalid_records",
    )


def pollution_alerts(df: DataFrame, threshold: float = fixed.PM25_ALERT) -> DataFrame:
    high = df.where((F.col("parameter") == "pm25") & (F.col("value") > threshold))
    return _alert(
        high, F.col("datetime_utc"), F.lit("warning"),
        F.concat(F.lit("High PM2.5: Location "), F.col("location_id").cast("string")),
        F.concat(F.lit("PM2.5 value "), F.format_string("%.2f", "value")), "location_id", "seq",
    )


def error_rate_alerts(rates: DataFrame, at: Column, limit: float = fixed.ERROR_RATE_ALERT) -> DataFrame:
    return _alert(
        rates.where(F.col("error_rate") > limit), at, F.lit("error"), F.lit("High Error Rate"),
        F.concat(F.lit("Error rate "), F.format_string("%.1f", F.col("error_rate") * 100), F.lit("%")), "total", "errors",
    )


def slow_responses(runs: DataFrame, metric: str = "api_response_time", limit: float = fixed.MAX_RESPONSE_SECONDS) -> DataFrame:
    """Runs over the response limit; runs without the metric never count."""
    return runs.where(F.try_element_at("metrics", F.lit(metric)) > limit)


def with_channels(alerts: DataFrame, enabled: bool = False, channels: dict[str, bool] | None = None) -> DataFrame:
    """Rows to deliver with their target channels; none while switched off."""
    targets = [F.lit(name) for name, on in (channels or {}).items() if on]
    named = F.array(*targets) if targets else F.array().cast("array<string>")
    return alerts.where(F.lit(enabled)).withColumn("channels", named)
