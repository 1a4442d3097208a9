"""Structured Streaming queries over landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom import schema
from airloom.catalog import base
from airloom.catalog.alerts import CONTEXT, R, run_log
from airloom.catalog.base import A, M, query
from airloom.catalog.landing import INGEST_HIST
from airloom.catalog.rows import nested_record
from airloom.plans.ingest import since_bookmark
from airloom.session import scratch_path
from airloom.sources import landed
from airloom.sources.store import MeasurementStore
from airloom.streaming.daily import daily_means_stream, open_days, write_closed_days
from airloom.streaming.daily_index import daily_index_stream, open_day_indices
from airloom.streaming.ingest import backlog_share, read_records, stream_ingest, stream_records
from airloom.streaming.streaks import read_runs_stream, send_alerts, sent_alerts, streaks_stream

FILE_RECORDS = 4000
FILES_PER_BATCH = 10


def land_lines(spark, sf_dir) -> str:
    """Records as JSON lines, with cut-off lines in files of their own."""
    m = base.measurements(spark, sf_dir)
    path = scratch_path(spark, "lines")
    m.select(nested_record(m).alias("r")).select("r.*").write.option("maxRecordsPerFile", FILE_RECORDS).json(path)
    # cut-off lines, which must neither stop the load nor become rows
    cut = m.where("seq % 100 = 7").select(F.substring(F.to_json(nested_record(m)), 1, 40).alias("line"))
    cut.write.mode("append").text(path)
    return path


def streamed_store(spark, sf_dir) -> MeasurementStore:
    """The landed lines, loaded by the stream in several batches."""
    lines = land_lines(spark, sf_dir)
    records = stream_records(spark, lines, backlog_share(spark, lines, FILES_PER_BATCH))
    kept = MeasurementStore(spark, scratch_path(spark, "store"), records.schema)
    stream_ingest(records, kept, scratch_path(spark, "checkpoint")).awaitTermination()
    return kept


@query("streamed_ingest", "STR-1 STR-2 STR-7", f"""
WITH {INGEST_HIST} SELECT location_id, parameter_id, sensor_id, datetime_utc::VARCHAR AS datetime_utc, datetime_to_utc::VARCHAR AS datetime_to_utc FROM hk""")
def streamed_ingest(spark, sf_dir):
    kept = streamed_store(spark, sf_dir)
    return kept.read().select(*schema.INGEST_KEY)


@query("streamed_state", "STR-1 SNK-4", f"""
WITH {INGEST_HIST} SELECT location_id, parameter, max(datetime_to_utc)::VARCHAR AS last_fetch_time FROM bk GROUP BY 1, 2""")
def streamed_state(spark, sf_dir):
    kept = streamed_store(spark, sf_dir)
    return kept.read_state().select("location_id", "parameter", "last_fetch_time")


@query("streamed_daily_means", "STR-6 STR-4", f"""
WITH {M}, e AS (SELECT max(datetime_local) AS latest FROM m)
SELECT parameter, location_id, date::VARCHAR AS date, round(avg(value) + 1e-9, 6) AS mean, count(*) AS n,
  date + INTERVAL 1 DAY <= any_value(latest) - INTERVAL 1 DAY AS is_closed FROM (SELECT *, datetime_local::DATE AS date FROM m), e GROUP BY parameter, location_id, date""")
def streamed_daily_means(spark, sf_dir):
    """Days the watermark has closed, and the last, still open ones as they stand."""
    lines = land_lines(spark, sf_dir)
    path, checkpoint = scratch_path(spark, "daily"), scratch_path(spark, "checkpoint")
    means = daily_means_stream(landed.accepted(stream_records(spark, lines)))
    write_closed_days(means, path, checkpoint).awaitTermination()
    closed = spark.read.schema(means.schema).parquet(path)
    still_open = open_days(landed.accepted(read_records(spark, lines)), closed)
    return closed.withColumn("is_closed", F.lit(True)).unionByName(still_open.withColumn("is_closed", F.lit(False)))


@query("streamed_daily_aqi", "STR-6 AGG-15 SCL-M4", f"""
WITH {A}, e AS (SELECT max(datetime_local) AS latest FROM m)
SELECT location_id, date::VARCHAR AS date, round(avg(aqi_overall) + 1e-9, 6) AS aqi, date + INTERVAL 1 DAY <= any_value(latest) - INTERVAL 1 DAY AS is_closed
FROM (SELECT *, datetime_local::DATE AS date FROM a), e GROUP BY location_id, date""")
def streamed_daily_aqi(spark, sf_dir):
    """The store is loaded twice, and the stream goes on from its checkpoint after each load."""
    m = base.measurements(spark, sf_dir)
    kept = MeasurementStore(spark, scratch_path(spark, "store"), m.schema)
    path, checkpoint = scratch_path(spark, "daily_aqi"), scratch_path(spark, "checkpoint")
    first = F.col("datetime_utc") < F.lit("2024-01-16").cast("timestamp_ntz")
    for load in (first, ~first):
        kept.append(m.where(load))
        days = daily_index_stream(kept.read_stream(), parameters=base.PARAMETERS)
        write_closed_days(days, path, checkpoint).awaitTermination()
    closed = spark.read.schema(days.schema).parquet(path).drop("n")
    still_open = open_day_indices(kept.read(), closed, base.PARAMETERS)
    return closed.withColumn("is_closed", F.lit(True)).unionByName(still_open.withColumn("is_closed", F.lit(False)))


@query("late_sensor_records", "STR-3", f"""
WITH {M}, b AS (SELECT location_id, parameter, max(datetime_to_utc) AS mark FROM m WHERE datetime_utc < TIMESTAMP '2024-01-16' GROUP BY 1, 2)
SELECT seq, location_id, parameter FROM m LEFT JOIN b USING (location_id, parameter) WHERE mark IS NULL OR datetime_utc >= mark - INTERVAL 2 DAY""")
def late_sensor_records(spark, sf_dir):
    """Bookmarks per location and parameter with two days of allowed lateness."""
    m = base.measurements(spark, sf_dir)
    state = m.where("datetime_utc < TIMESTAMP_NTZ '2024-01-16 00:00:00'").groupBy("location_id", "parameter").agg(
        F.max("datetime_to_utc").alias("last_fetch_time")
    )
    return since_bookmark(m, state, "2 days").select("seq", "location_id", "parameter")


@query("streamed_streak_alerts", "WIN-3 ALR-1 ALR-2 ALR-4", f"""
WITH {R} SELECT start_time::VARCHAR AS timestamp, CASE WHEN recovered THEN 'info' WHEN outcome = 'exception' THEN 'critical' ELSE 'error' END AS level,
  CASE WHEN recovered THEN 'Pipeline Recovered' WHEN outcome = 'exception' THEN 'Pipeline Critical Failure' ELSE 'Pipeline Consecutive Failures' END AS title,
  CASE WHEN recovered THEN 'Pipeline recovered from previous failures'
    ELSE 'Pipeline has failed ' || streak || ' times' || CASE WHEN outcome = 'exception' THEN '' ELSE ' consecutively' END END AS message, {CONTEXT}
FROM sk WHERE streak >= 3 OR recovered""")
def streamed_streak_alerts(spark, sf_dir):
    """Runs are logged in two loads; the counters go on from the checkpoint."""
    log = run_log(spark, sf_dir).select("location_id", "run_id", "start_time", "outcome")
    path, alerts, checkpoint = (scratch_path(spark, n) for n in ("runs", "alerts", "checkpoint"))
    early = F.col("start_time") < F.lit("2024-01-12").cast("timestamp_ntz")
    for load in (early, ~early):
        log.where(load).write.mode("append").parquet(path)
        streaks = streaks_stream(read_runs_stream(spark, path, log.schema), ["location_id"])
        send_alerts(streaks, alerts, checkpoint).awaitTermination()
    return sent_alerts(spark, alerts)
