"""Deduplication, merge and incremental batch queries.

History is every reading before 16 January, the fetched batch every reading
from 15 January on: one day overlaps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom import schema
from airloom.catalog import base
from airloom.catalog.base import LM, M, OM, query
from airloom.operators import dedup, quality
from airloom.plans import ingest as plan
from airloom.plans import merge, runs

RUN_TIME = "2024-01-31 00:00:00"
PLACE_KEY = ["location_id", "parameter", "datetime_utc"]
LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["datetime_utc", "l_partkey", "location_id", "value"]

HIST = f"""{M},
h AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY location_id, parameter, datetime_utc ORDER BY seq) AS rn
  FROM m WHERE datetime_utc < TIMESTAMP '2024-01-16') WHERE rn = 1),
f AS (SELECT * FROM m WHERE datetime_utc >= TIMESTAMP '2024-01-15'),
nw AS (SELECT x.* EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY location_id, parameter, datetime_utc ORDER BY seq) AS rn FROM f) x
  ANTI JOIN h USING (location_id, parameter, datetime_utc) WHERE rn = 1)"""


def history_and_batch(spark, sf_dir):
    m = base.measurements(spark, sf_dir)
    history = m.where("datetime_utc < TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    fetched = m.where("datetime_utc >= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return dedup.keep_first(history, PLACE_KEY, ["seq"]), fetched


def new_rows(spark, sf_dir):
    history, fetched = history_and_batch(spark, sf_dir)
    return history, fetched, dedup.first_seen(fetched, history, PLACE_KEY, ["seq"])


@query("first_readings", "WIN-1", f"""
WITH {M} SELECT seq, location_id, parameter, datetime_utc::VARCHAR AS datetime_utc, round(value + 1e-9, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id, parameter, datetime_utc ORDER BY seq) AS rn FROM m) WHERE rn = 1""")
def first_readings(spark, sf_dir):
    return dedup.keep_first(base.measurements(spark, sf_dir), PLACE_KEY, ["seq"]).select(
        "seq", *PLACE_KEY, "value"
    )


@query("first_readings_by_ingest_key", "WIN-1 SCL-S1", f"""
WITH {M} SELECT seq, location_id, sensor_id FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id, parameter_id, sensor_id, datetime_utc, datetime_to_utc ORDER BY seq) AS rn FROM m) WHERE rn = 1""")
def first_readings_by_ingest_key(spark, sf_dir):
    kept = dedup.keep_first(base.measurements(spark, sf_dir), schema.INGEST_KEY, ["seq"])
    return kept.select("seq", "location_id", "sensor_id")


@query("first_order_lines", "WIN-1", f"""
WITH {LM} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, datetime_utc::VARCHAR AS datetime_utc, l_partkey, location_id, round(value + 1e-9, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY datetime_utc, l_partkey, location_id, value) AS rn FROM lm) WHERE rn = 1""")
def first_order_lines(spark, sf_dir):
    kept = dedup.keep_first(base.line_readings(spark, sf_dir), LINE_KEY, LINE_ORDER)
    return kept.select(*LINE_KEY, *LINE_ORDER)


@query("new_readings", "JN-1 SET-3 STR-2", f"""
WITH {HIST} SELECT seq, location_id, parameter, datetime_utc::VARCHAR AS datetime_utc FROM nw""")
def new_readings(spark, sf_dir):
    return new_rows(spark, sf_dir)[2].select("seq", *PLACE_KEY)


@query("lines_outside_finished_orders", "JN-1 SET-3", f"""
WITH {LM} SELECT l_orderkey, count(*) AS lines FROM lm ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey) GROUP BY 1""")
def lines_outside_finished_orders(spark, sf_dir):
    finished = base.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = dedup.not_in(base.line_readings(spark, sf_dir), finished, ["l_orderkey"])
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("history_and_new", "SET-2", f"""
WITH {HIST} SELECT seq, location_id, parameter, datetime_utc::VARCHAR AS datetime_utc, round(value + 1e-9, 6) AS value FROM (SELECT * FROM h UNION ALL SELECT * FROM nw)""")
def history_and_new(spark, sf_dir):
    history, _, new = new_rows(spark, sf_dir)
    return history.unionByName(new).select("seq", *PLACE_KEY, "value")


@query("merged_collections", "SET-4 WIN-1", f"""
WITH {M}, s AS (SELECT *, 0 AS src FROM m WHERE datetime_utc < TIMESTAMP '2024-01-16' UNION ALL SELECT *, 1 FROM m WHERE datetime_utc >= TIMESTAMP '2024-01-15')
SELECT seq, location_id, parameter_id, datetime_utc::VARCHAR AS datetime_utc FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id, datetime_utc, parameter_id ORDER BY src, seq) AS rn FROM s) WHERE rn = 1""")
def merged_collections(spark, sf_dir):
    m = base.measurements(spark, sf_dir)
    parts = [m.where("datetime_utc < TIMESTAMP_NTZ '2024-01-16 00:00:00'"), m.where("datetime_utc >= TIMESTAMP_NTZ '2024-01-15 00:00:00'")]
    return merge.merge(parts).select("seq", "location_id", "parameter_id", "datetime_utc")


@query("records_of_all_sources", "SET-1", f"""
WITH {M}, {OM}, {LM} SELECT parameter, count(*) AS n FROM (SELECT parameter FROM m UNION ALL SELECT parameter FROM om UNION ALL SELECT parameter FROM lm) GROUP BY 1""")
def records_of_all_sources(spark, sf_dir):
    cols = ["parameter", "value", "datetime_utc"]
    sources = [f(spark, sf_dir).select(*cols) for f in (base.measurements, base.order_readings, base.line_readings)]
    union = sources[0].unionByName(sources[1]).unionByName(sources[2])
    return union.groupBy("parameter").agg(F.count(F.lit(1)).alias("n"))


STATS = f"""{HIST},
st AS (SELECT location_id, sum(fe)::BIGINT AS fetched_records, sum(ne)::BIGINT AS new_records, (sum(fe) - sum(ne))::BIGINT AS duplicates_removed,
  (sum(be) + sum(ne))::BIGINT AS total_records, 'success' AS status
  FROM (SELECT location_id, 1 AS fe, 0 AS ne, 0 AS be FROM f UNION ALL SELECT location_id, 0, 1, 0 FROM nw UNION ALL SELECT location_id, 0, 0, 1 FROM h) GROUP BY 1)"""


def stats(spark, sf_dir):
    history, fetched, new = new_rows(spark, sf_dir)
    return plan.location_stats(fetched, new, history)


@query("ingest_stats_by_location", "AGG-23 STR-7", f"WITH {STATS} SELECT * FROM st")
def ingest_stats_by_location(spark, sf_dir):
    return stats(spark, sf_dir)


@query("ingest_summary", "AGG-24", f"""
WITH {STATS} SELECT count(*) AS total_locations, count(*) FILTER (WHERE status = 'success') AS successful,
  count(*) FILTER (WHERE status = 'error') AS failed, sum(new_records)::BIGINT AS total_new_records FROM st""")
def ingest_summary(spark, sf_dir):
    return plan.run_summary(stats(spark, sf_dir))


@query("locations_with_few_new_records", "VAL-12", f"WITH {STATS} SELECT * FROM st WHERE new_records < 450")
def locations_with_few_new_records(spark, sf_dir):
    return quality.too_few_records(stats(spark, sf_dir), 450)


@query("silent_locations", "VAL-12 AGG-24", f"""
WITH {STATS} SELECT r_regionkey::BIGINT AS location_id, 0 AS fetched_records, 0 AS new_records, 0 AS duplicates_removed, 0 AS total_records, 'success' AS status
FROM region WHERE r_regionkey NOT IN (SELECT location_id FROM st) UNION ALL SELECT * FROM st WHERE new_records < 1""")
def silent_locations(spark, sf_dir):
    """Configured locations (those with a name) and sending ones without a new record."""
    history, fetched, new = new_rows(spark, sf_dir)
    return quality.too_few_records(plan.location_stats(fetched, new, history, configured=base.location_names(spark, sf_dir)))


@query("run_row_of_an_ingest", "AGG-28 SNK-5", f"""
WITH {STATS} SELECT 'r1' AS run_id, '2024-01-30 23:58:00' AS start_time, '{RUN_TIME}' AS end_time, sum(fetched_records)::DOUBLE AS total_records_fetched,
  sum(duplicates_removed)::DOUBLE AS total_records_deduplicated, count(*)::DOUBLE AS total_locations_processed,
  count(*)::DOUBLE AS successful_locations, 0::DOUBLE AS failed_locations, 120::DOUBLE AS duration_seconds, 0::BIGINT AS total_errors, 120::DOUBLE AS elapsed_seconds FROM st""")
def run_row_of_an_ingest(spark, sf_dir):
    return runs.run_metrics(runs.run_row(stats(spark, sf_dir), "r1", "2024-01-30 23:58:00", RUN_TIME))


BOOKMARKS = f"""{M},
b AS (SELECT sensor_id, max(datetime_to_utc) AS mark FROM m WHERE datetime_utc < TIMESTAMP '2024-01-02' GROUP BY 1)"""


@query("records_since_bookmark", "FLT-6 JN-5 SRC-8 STR-1 STR-3", f"""
WITH {BOOKMARKS} SELECT seq, sensor_id, datetime_utc::VARCHAR AS datetime_utc FROM m LEFT JOIN b USING (sensor_id)
WHERE mark IS NULL OR datetime_utc >= mark - INTERVAL 6 HOUR""")
def records_since_bookmark(spark, sf_dir):
    m = base.measurements(spark, sf_dir)
    state = m.where("datetime_utc < TIMESTAMP_NTZ '2024-01-02 00:00:00'").groupBy("sensor_id").agg(
        F.max("datetime_to_utc").alias("last_fetch_time")
    )
    return plan.since_bookmark(m, state, "6 hours", keys=["sensor_id"]).select("seq", "sensor_id", "datetime_utc")


@query("next_bookmarks", "AGG-26 SNK-4 STR-1", f"""
WITH {HIST}, c AS (SELECT location_id, parameter, count(*) AS n FROM nw GROUP BY 1, 2)
SELECT location_id, parameter, max(datetime_to_utc)::VARCHAR AS last_fetch_time, coalesce(any_value(n), 0)::BIGINT AS last_records_count,
  '{RUN_TIME}' AS last_successful_run FROM f LEFT JOIN c USING (location_id, parameter) GROUP BY 1, 2""")
def next_bookmarks(spark, sf_dir):
    _, fetched, new = new_rows(spark, sf_dir)
    return plan.next_state(fetched, plan.new_counts(new), RUN_TIME)


MERGE = f"""{M}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id, datetime_utc, parameter_id ORDER BY seq) AS rn FROM m) WHERE rn = 1),
ms AS (SELECT location_id, any_value(b.n) AS before, count(*) AS after, any_value(b.n) - count(*) AS duplicates,
  arg_min(datetime_local, (datetime_utc, seq))::VARCHAR AS first_local, arg_max(datetime_local, (datetime_utc, seq))::VARCHAR AS last_local
  FROM d JOIN (SELECT location_id, count(*) AS n FROM m GROUP BY 1) b USING (location_id) GROUP BY 1)"""


@query("merge_summary", "AGG-25 WIN-5", f"WITH {MERGE} SELECT * FROM ms")
def merge_summary(spark, sf_dir):
    m = base.measurements(spark, sf_dir)
    return merge.merge_summary(m, merge.merge([m]))


@query("merge_totals", "AGG-25", f"""
WITH {MERGE} SELECT sum(before)::BIGINT AS before, sum(duplicates)::BIGINT AS duplicates, sum(after)::BIGINT AS after FROM ms""")
def merge_totals(spark, sf_dir):
    m = base.measurements(spark, sf_dir)
    return merge.merge_totals(merge.merge_summary(m, merge.merge([m])))


@query("place_in_time_order", "SRT-1 WIN-6", f"""
WITH {M}, t AS (SELECT seq, location_id, CASE WHEN k < 95 THEN datetime_utc END AS moment, datetime_utc::DATE AS day FROM m)
SELECT seq, location_id, day::VARCHAR AS day, row_number() OVER (PARTITION BY location_id, day ORDER BY moment NULLS FIRST, seq) - 1 AS index FROM t""")
def place_in_time_order(spark, sf_dir):
    m = base.measurements(spark, sf_dir).select(
        "seq", "location_id", F.when(F.col("k") < 95, F.col("datetime_utc")).alias("at"), F.to_date("datetime_utc").alias("day")
    )
    return quality.record_index(m, ["location_id", "day"], ["at", "seq"]).drop("at")
