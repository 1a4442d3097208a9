"""Run-log and alert queries. A run is one location's day of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.catalog import base
from airloom.catalog.base import M, query
from airloom.operators import aggregates
from airloom.plans import runs as plan
from airloom.schema import RUN


def run_log(spark, sf_dir) -> DataFrame:
    """Runs with metrics and errors; many ozone peaks make a run fail or crash."""
    m = base.measurements(spark, sf_dir)
    peak = (F.col("parameter") == "o3") & (F.col("value") > 0.05)
    days = m.groupBy("location_id", F.to_date("datetime_utc").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(peak).alias("peaks"), F.max("k").alias("slowest")
    )
    share = F.col("peaks") / F.col("n")
    start = F.col("day").cast("timestamp_ntz")
    error = F.struct(
        F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("ozone peaks").alias("error"),
        F.create_map(F.lit("location"), F.col("location_id").cast("string")).alias("context"),
    )
    return days.select(
        "location_id",
        F.concat_ws("_", F.col("location_id").cast("string"), F.date_format("day", "yyyyMMdd")).alias("run_id"),
        start.alias("start_time"),
        (start + F.make_interval(secs=F.col("n"))).alias("end_time"),
        F.map_from_arrays(
            F.array(F.lit("total_records_fetched"), F.lit("failed_locations"), F.lit("api_response_time")),
            F.array(F.col("n").cast("double"), F.col("peaks").cast("double"), F.col("slowest").cast("double")),
        ).alias("metrics"),
        F.when(share > 0.08, F.array(error)).otherwise(F.array().cast(RUN["errors"].dataType)).alias("errors"),
        F.when(share > 0.12, "exception").when(share > 0.08, "failed").otherwise("success").alias("outcome"),
    )


R = f"""{M},
dy AS (SELECT location_id, datetime_utc::DATE AS day, count(*) AS n, count(*) FILTER (WHERE parameter = 'o3' AND value > 0.05) AS peaks, max(k) AS slowest FROM m GROUP BY 1, 2),
rn AS (SELECT location_id, location_id || '_' || strftime(day, '%Y%m%d') AS run_id, day::TIMESTAMP AS start_time, day::TIMESTAMP + to_seconds(n) AS end_time, n, peaks, slowest,
  CASE WHEN peaks::DOUBLE / n > 0.12 THEN 'exception' WHEN peaks::DOUBLE / n > 0.08 THEN 'failed' ELSE 'success' END AS outcome FROM dy),
il AS (SELECT *, sum((outcome = 'success')::INT) OVER (PARTITION BY location_id ORDER BY start_time) AS island FROM rn),
sk AS (SELECT *, sum((outcome <> 'success')::INT) OVER (PARTITION BY location_id, island ORDER BY start_time)::BIGINT AS streak,
  outcome = 'success' AND coalesce(lag(outcome) OVER (PARTITION BY location_id ORDER BY start_time) <> 'success', false) AS recovered FROM il)"""


@query("run_metrics", "AGG-28 SCL-D12 SCL-J5", f"""
WITH {R} SELECT run_id, start_time::VARCHAR AS start_time, end_time::VARCHAR AS end_time, n::DOUBLE AS total_records_fetched, 0.0::DOUBLE AS total_records_deduplicated,
  0.0::DOUBLE AS total_locations_processed, 0.0::DOUBLE AS successful_locations, peaks::DOUBLE AS failed_locations, 0.0::DOUBLE AS duration_seconds,
  (outcome <> 'success')::BIGINT AS total_errors, n::DOUBLE AS elapsed_seconds FROM rn""")
def run_metrics(spark, sf_dir):
    return plan.run_metrics(run_log(spark, sf_dir))


@query("last_hundred_runs", "WIN-4", f"""
WITH {R} SELECT run_id, outcome FROM rn ORDER BY start_time DESC, run_id DESC LIMIT 100""")
def last_hundred_runs(spark, sf_dir):
    return plan.last_runs(run_log(spark, sf_dir)).select("run_id", "outcome")


@query("failure_streaks", "WIN-3", f"WITH {R} SELECT location_id, start_time::VARCHAR AS start_time, outcome, streak, recovered FROM sk")
def failure_streaks(spark, sf_dir):
    return plan.failure_streaks(run_log(spark, sf_dir), ("location_id",)).select(
        "location_id", "start_time", "outcome", "streak", "recovered"
    )


CONTEXT = """'{"outcome":"' || outcome || '","streak":' || streak || '}' AS context"""


@query("streak_alerts", "ALR-1 ALR-2", f"""
WITH {R} SELECT start_time::VARCHAR AS timestamp, CASE WHEN outcome = 'exception' THEN 'critical' ELSE 'error' END AS level,
  CASE WHEN outcome = 'exception' THEN 'Pipeline Critical Failure' ELSE 'Pipeline Consecutive Failures' END AS title,
  'Pipeline has failed ' || streak || ' times' || CASE WHEN outcome = 'exception' THEN '' ELSE ' consecutively' END AS message, {CONTEXT}
FROM sk WHERE streak >= 3""")
def streak_alerts(spark, sf_dir):
    return plan.streak_alerts(plan.failure_streaks(run_log(spark, sf_dir), ("location_id",)))


@query("recovery_events", "ALR-4", f"""
WITH {R} SELECT start_time::VARCHAR AS timestamp, 'info' AS level, 'Pipeline Recovered' AS title,
  'Pipeline recovered from previous failures' AS message, {CONTEXT} FROM sk WHERE recovered""")
def recovery_events(spark, sf_dir):
    return plan.recovery_events(plan.failure_streaks(run_log(spark, sf_dir), ("location_id",)))


@query("slow_runs", "VAL-13", f"WITH {R} SELECT run_id, outcome FROM rn WHERE slowest > 98")
def slow_runs(spark, sf_dir):
    return plan.slow_responses(run_log(spark, sf_dir), limit=98).select("run_id", "outcome")


POLLUTION = f"""
WITH {M} SELECT datetime_utc::VARCHAR AS timestamp, 'warning' AS level, 'High PM2.5: Location ' || location_id AS title,
  'PM2.5 value ' || printf('%.2f', value) AS message, '{{"location_id":' || location_id || ',"seq":' || seq || '}}' AS context"""


@query("pollution_alerts", "ALR-5 FLT-11", f"{POLLUTION} FROM m WHERE parameter = 'pm25' AND value > 150")
def pollution_alerts(spark, sf_dir):
    return plan.pollution_alerts(base.measurements(spark, sf_dir))


@query("alerts_to_deliver", "ALR-7", f"{POLLUTION}, 'slack | webhook' AS channels FROM m WHERE parameter = 'pm25' AND value > 150")
def alerts_to_deliver(spark, sf_dir):
    alerts = plan.pollution_alerts(base.measurements(spark, sf_dir))
    return plan.with_channels(alerts, True, {"email": False, "slack": True, "webhook": True})


@query("error_rate_alerts", "ALR-6 AGG-34", f"""
WITH {M}, e AS (SELECT location_id, datetime_utc::DATE AS day, count(*) AS total, count(*) FILTER (WHERE parameter = 'o3' AND value > 0.05) AS errors FROM m GROUP BY 1, 2)
SELECT day::TIMESTAMP::VARCHAR AS timestamp, 'error' AS level, 'High Error Rate' AS title, 'Error rate ' || printf('%.1f', errors::DOUBLE / total * 100) || '%' AS message,
  '{{"total":' || total || ',"errors":' || errors || '}}' AS context FROM e WHERE errors::DOUBLE / total > 0.1""")
def error_rate_alerts(spark, sf_dir):
    m = base.measurements(spark, sf_dir).withColumn("day", F.to_date("datetime_utc"))
    failed = (F.col("parameter") == "o3") & (F.col("value") > 0.05)
    rates = aggregates.error_rate(m, failed, "location_id", "day")
    return plan.error_rate_alerts(rates, F.col("day").cast("timestamp_ntz"))
