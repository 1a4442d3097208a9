"""Projections, filters, lookups, scalar functions and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom.catalog import base
from airloom.catalog.base import A, LM, M, NAMES, query
from airloom.functions import calendar, reference_levels, text
from airloom.functions import aqi as index
from airloom.operators import aggregates, filters, intervals, joins, rolling, sampling
from airloom.operators.pivot import aqi_records
from airloom.sources import landed

AS_OF = "2024-01-31 00:00:00"


def iso(ts, suffix: str):
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(suffix))


def nested_record(df):
    """Readings as the nested record they arrive in."""
    return F.struct(
        F.col("value"),
        F.struct(F.col("parameter_id").alias("id"), F.col("parameter").alias("name"), F.col("units")).alias("parameter"),
        F.struct(
            F.lit("01:00:00").alias("interval"),
            F.struct(iso(F.col("datetime_utc"), "Z").alias("utc"), iso(F.col("datetime_local"), "+05:45").alias("local")).alias("datetimeFrom"),
            F.struct(iso(F.col("datetime_to_utc"), "Z").alias("utc")).alias("datetimeTo"),
        ).alias("period"),
        F.col("location_id").alias("locationId"),
        F.array(F.struct(F.col("sensor_id").alias("id"))).alias("sensors"),
    )


@query("flat_measurements", "PRJ-1 SCL-D1 SCL-D2 SCL-J1 SCL-J2", f"""
WITH {M} SELECT seq, location_id, parameter_id, parameter, units, round(value + 1e-9, 6) AS value,
  datetime_utc::VARCHAR AS datetime_utc, datetime_local::VARCHAR AS datetime_local, '+05:45' AS utc_offset,
  datetime_to_utc::VARCHAR AS datetime_to_utc, sensor_id FROM m""")
def flat_measurements(spark, sf_dir):
    m = base.measurements(spark, sf_dir)
    return m.select("seq", nested_record(m).alias("record")).select("seq", *landed.flat(F.col("record")))


@query("time_features", "PRJ-2 SCL-D3 SCL-D4 SCL-D5", f"""
WITH {M} SELECT seq, datetime_local::DATE::VARCHAR AS date, hour(datetime_local)::BIGINT AS hour,
  dayname(datetime_local) AS day_of_week FROM m""")
def time_features(spark, sf_dir):
    local = F.col("datetime_local")
    return base.measurements(spark, sf_dir).select(
        "seq", F.to_date(local).alias("date"), F.hour(local).alias("hour"), calendar.day_name(local).alias("day_of_week")
    )


@query("period_labels", "SCL-D6 SCL-D7 SCL-D8", f"""
WITH {M} SELECT seq, strftime(datetime_local, '%Y-%m') AS month,
  date_trunc('week', datetime_local)::DATE::VARCHAR || '/' || (date_trunc('week', datetime_local)::DATE + 6)::VARCHAR AS week,
  datetime_local::DATE::VARCHAR AS day FROM m""")
def period_labels(spark, sf_dir):
    local = F.col("datetime_local")
    return base.measurements(spark, sf_dir).select(
        "seq", calendar.month_label(local).alias("month"), calendar.week_label(local).alias("week"),
        calendar.day_label(local).alias("day"),
    )


@query("reading_ages", "SCL-D11 SCL-D12 SCL-D13", f"""
WITH {M} SELECT seq, CAST(floor(epoch(TIMESTAMP '2024-01-20 12:00:00' - datetime_utc) / 86400) AS BIGINT) AS whole_days,
  datetime_utc > TIMESTAMP '2024-01-20 12:00:00' AS in_future,
  round(epoch(datetime_to_utc - datetime_utc) + 1e-9, 6)::DOUBLE AS seconds, strftime(datetime_utc, '%Y%m%d_%H%M%S') AS run_id
FROM m WHERE datetime_utc <= TIMESTAMP '2024-01-20 12:00:00'
UNION ALL
SELECT seq, -CAST(floor(epoch(datetime_utc - TIMESTAMP '2024-01-20 12:00:00') / 86400) AS BIGINT), true,
  round(epoch(datetime_to_utc - datetime_utc) + 1e-9, 6)::DOUBLE, strftime(datetime_utc, '%Y%m%d_%H%M%S')
FROM m WHERE datetime_utc > TIMESTAMP '2024-01-20 12:00:00'""")
def reading_ages(spark, sf_dir):
    at = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    start = F.col("datetime_utc")
    return base.measurements(spark, sf_dir).select(
        "seq", calendar.elapsed_days(start, at).alias("whole_days"), (start > at).alias("in_future"),
        calendar.seconds_between(start, F.col("datetime_to_utc")).alias("seconds"), calendar.run_id(start).alias("run_id"),
    )


@query("text_keys", "SCL-S1 SCL-S2 SCL-S3 SCL-S8", f"""
WITH {M} SELECT seq,
  coalesce(location_id::VARCHAR, '') || '_' || coalesce(CASE WHEN k > 90 THEN NULL ELSE parameter_id END::VARCHAR, '') || '_' ||
    coalesce(sensor_id::VARCHAR, '') || '_' || datetime_utc::VARCHAR || '_' || datetime_to_utc::VARCHAR AS ingest_key,
  location_id || '_' || datetime_utc::VARCHAR || '_' || parameter_id AS merge_key,
  upper(parameter) AS label, parameter || ' value ' || printf('%.5f', value) AS message FROM m""")
def text_keys(spark, sf_dir):
    known = F.when(F.col("k") <= 90, F.col("parameter_id"))
    return base.measurements(spark, sf_dir).select(
        "seq",
        text.joined_key(F.col("location_id"), known, F.col("sensor_id"), F.col("datetime_utc"), F.col("datetime_to_utc")).alias("ingest_key"),
        text.joined_key(F.col("location_id"), F.col("datetime_utc"), F.col("parameter_id")).alias("merge_key"),
        F.upper("parameter").alias("label"),
        F.concat(F.col("parameter"), F.lit(" value "), text.decimals(F.col("value"), 5)).alias("message"),
    )


@query("json_properties", "SCL-J5 SCL-J7", """
SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  0::BIGINT AS absent, '{"type":"' || event_type || '","user":' || user_id || '}' AS context FROM events""")
def json_properties(spark, sf_dir):
    ev = base.table(spark, sf_dir, "events").withColumn("_map", F.from_json("props", "map<string,bigint>"))
    return ev.select(
        F.col("event_id").alias("seq"), F.coalesce(F.try_element_at("_map", F.lit("k")), F.lit(0)).alias("k"),
        F.coalesce(F.try_element_at("_map", F.lit("absent")), F.lit(0)).cast("long").alias("absent"),
        F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("context"),
    )


@query("aqi_records", "PRJ-3 AGG-8 JN-6 SCL-M1 SCL-M3 SCL-M4 SCL-M5", f"""
WITH {A} SELECT location_id, datetime_utc::VARCHAR AS datetime_utc, datetime_local::VARCHAR AS datetime_local,
  round(pm1 + 1e-9, 6) AS pm1, round(pm25 + 1e-9, 6) AS pm25, round(o3 + 1e-9, 6) AS o3, round(temperature + 1e-9, 6) AS temperature,
  round(relativehumidity + 1e-9, 6) AS relativehumidity, aqi_pm25, aqi_o3, aqi_overall, aqi_category, aqi_color FROM a""")
def aqi_per_record(spark, sf_dir):
    return base.aqi(spark, sf_dir)


@query("aqi_with_pm10", "SCL-M2 SCL-M4", f"""
WITH {M}, w AS (
  SELECT location_id, datetime_utc, datetime_local,
    arg_min(value, seq) FILTER (WHERE parameter = 'pm25') AS pm25,
    arg_min(value, seq) FILTER (WHERE parameter = 'pm10') AS pm10
  FROM (SELECT * REPLACE (CASE parameter WHEN 'pm1' THEN 'pm10' ELSE parameter END AS parameter) FROM m) GROUP BY ALL),
x AS (SELECT *, {base.pm25_sql('pm25')} AS aqi_pm25, {base.pm10_sql('pm10')} AS aqi_pm10 FROM w)
SELECT location_id, datetime_utc::VARCHAR AS datetime_utc, aqi_pm25, aqi_pm10, greatest(aqi_pm25, aqi_pm10) AS aqi_overall FROM x""")
def aqi_with_pm10(spark, sf_dir):
    m = base.measurements(spark, sf_dir).withColumn(
        "parameter", F.when(F.col("parameter") == "pm1", "pm10").otherwise(F.col("parameter"))
    )
    return aqi_records(m, ["pm25", "pm10"], ("pm25", "pm10")).select(
        "location_id", "datetime_utc", "aqi_pm25", "aqi_pm10", "aqi_overall"
    )


BANDS = """b(band_low, band_high, index_low, index_high) AS (VALUES
  (0.0::DOUBLE, 12.0::DOUBLE, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
  (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300), (250.5, 500.4, 301, 500))"""


@query("aqi_band_of_reading", "JN-8", f"""
WITH {M}, {BANDS} SELECT seq, band_low, band_high, index_low::BIGINT AS index_low, index_high::BIGINT AS index_high
FROM m LEFT JOIN b ON value BETWEEN band_low AND band_high WHERE parameter = 'pm25'""")
def aqi_band_of_reading(spark, sf_dir):
    pm25 = base.measurements(spark, sf_dir).where("parameter = 'pm25'")
    banded = pm25.select("seq", index.band_of(F.col("value"), fixed.PM25_BANDS).alias("b"))
    return banded.select(
        "seq", "b.band_low", "b.band_high", F.col("b.index_low").cast("long").alias("index_low"),
        F.col("b.index_high").cast("long").alias("index_high"),
    )


@query("reference_levels", "SCL-M6 SCL-M8", f"""
WITH {M} SELECT seq, CASE WHEN parameter = 'pm25' THEN 15.0::DOUBLE END AS guideline,
  CASE WHEN parameter = 'pm25' THEN value > 15 END AS exceeds,
  value < 10 OR value > 20 AS out_of_range FROM m""")
def levels(spark, sf_dir):
    p, v = F.col("parameter"), F.col("value")
    return base.measurements(spark, sf_dir).select(
        "seq", reference_levels.who_guideline(p).alias("guideline"),
        reference_levels.exceeds_guideline(p, v).alias("exceeds"), (~v.between(10, 20)).alias("out_of_range"),
    )


@query("index_without_gaps", "SCL-M1", f"""
WITH {M}, t AS (SELECT seq, floor(value * 10 + 1e-9) / 10 AS c FROM m WHERE parameter = 'pm25')
SELECT seq, {base.pm25_sql('c')} AS aqi FROM t""")
def index_without_gaps(spark, sf_dir):
    pm25 = base.measurements(spark, sf_dir).where("parameter = 'pm25'")
    return pm25.select("seq", index.aqi_pm25(F.col("value"), truncate=True).alias("aqi"))


@query("named_locations", "JN-2", f"""
WITH {M}, {NAMES} SELECT m.seq, m.location_id, {base.name_sql('m')} AS location_name FROM m LEFT JOIN nm USING (location_id)""")
def named_locations(spark, sf_dir):
    return joins.with_location_name(
        base.measurements(spark, sf_dir), base.location_names(spark, sf_dir)
    ).select("seq", "location_id", "location_name")


@query("denied_location_removed", "FLT-1", f"""
WITH {M} SELECT count(*) AS records_before, count(*) FILTER (WHERE location_id NOT IN (10)) AS records_after,
  count(*) FILTER (WHERE location_id IN (10)) AS records_removed FROM m""")
def denied_location_removed(spark, sf_dir):
    return filters.removal_count(base.measurements(spark, sf_dir), [10])


@query("locations_after_deny_list", "FLT-1 AGG-31", f"""
WITH {M} SELECT location_id, count(*) AS n FROM m WHERE location_id NOT IN (10) GROUP BY location_id""")
def locations_after_deny_list(spark, sf_dir):
    return aggregates.records_per_location(filters.without_locations(base.measurements(spark, sf_dir), [10]))


@query("parameter_presence", "FLT-5 FLT-7", f"""
WITH {M}, k(parameter) AS (VALUES ('pm1'), ('pm10'), ('pm25'), ('o3'), ('relativehumidity'), ('temperature'), ('um003')),
c AS (SELECT parameter, count(*) AS n FROM m GROUP BY parameter)
SELECT k.parameter, coalesce(n, 0)::BIGINT AS n, n IS NOT NULL AS present FROM k LEFT JOIN c USING (parameter)""")
def parameter_presence(spark, sf_dir):
    from airloom.operators.pivot import PARAMETERS

    return filters.parameter_presence(base.measurements(spark, sf_dir), PARAMETERS)


@query("retained_records", "FLT-8", f"""
WITH {M} SELECT seq, location_id, datetime_utc::VARCHAR AS datetime_utc FROM m
WHERE datetime_utc > TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY""")
def retained_records(spark, sf_dir):
    return filters.retained(base.measurements(spark, sf_dir), "2024-02-10 00:00:00").select("seq", "location_id", "datetime_utc")


@query("recent_week_of_location", "FLT-9 FLT-3", f"""
WITH {M} SELECT seq, parameter, round(value + 1e-9, 6) AS value, datetime_utc::VARCHAR AS datetime_utc FROM m
WHERE location_id = 7 AND datetime_utc > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def recent_week_of_location(spark, sf_dir):
    return filters.recent_of_location(base.measurements(spark, sf_dir), 7, AS_OF).select("seq", "parameter", "value", "datetime_utc")


@query("location_parameter_since", "FLT-10 FLT-2", f"""
WITH {M} SELECT seq, round(value + 1e-9, 6) AS value, datetime_utc::VARCHAR AS datetime_utc FROM m
WHERE location_id = 3 AND parameter = 'pm25' AND datetime_utc >= TIMESTAMP '2024-01-10 00:00:00'""")
def location_parameter_since(spark, sf_dir):
    return filters.location_parameter_since(
        base.measurements(spark, sf_dir), 3, "pm25", "2024-01-10 00:00:00"
    ).select("seq", "value", "datetime_utc")


@query("pm25_over_threshold", "FLT-11", f"""
WITH {M} SELECT seq, location_id, round(value + 1e-9, 6) AS value FROM m WHERE parameter = 'pm25' AND value > 150""")
def pm25_over_threshold(spark, sf_dir):
    return filters.over_threshold(base.measurements(spark, sf_dir)).select("seq", "location_id", "value")


@query("random_sample", "SMP-1", f"""
WITH {M} SELECT seq, location_id, parameter FROM m ORDER BY md5('7-' || seq), seq LIMIT 500""")
def random_sample(spark, sf_dir):
    return sampling.random_sample(base.measurements(spark, sf_dir), 500, seed=7).select("seq", "location_id", "parameter")


@query("latest_per_location", "LIM-4", f"""
WITH {M} SELECT location_id, seq, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY datetime_utc DESC, seq DESC) AS recency FROM m) WHERE recency <= 10""")
def latest_per_location(spark, sf_dir):
    return sampling.latest_per_location(base.measurements(spark, sf_dir)).select("location_id", "seq", "recency")


@query("latest_shipments_per_supplier", "LIM-4", f"""
WITH {LM} SELECT location_id, l_orderkey, l_linenumber::BIGINT AS l_linenumber, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY datetime_utc DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, value DESC) AS recency
  FROM lm) WHERE recency <= 10""")
def latest_shipments_per_supplier(spark, sf_dir):
    rows = base.line_readings(spark, sf_dir).withColumn(
        "seq", F.struct("l_orderkey", "l_linenumber", "l_partkey", "value")
    )
    return sampling.latest_per_location(rows).select("location_id", "l_orderkey", "l_linenumber", "recency")


@query("rolling_day_mean", "WIN-7", f"""
WITH {M}, x AS (
  SELECT DISTINCT location_id, parameter, datetime_utc,
    sum(value) OVER w / count(value) OVER w AS rolling_mean, count(value) OVER w AS readings
  FROM m WINDOW w AS (PARTITION BY location_id, parameter ORDER BY datetime_utc RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW))
SELECT location_id, parameter, datetime_utc::VARCHAR AS datetime_utc, round(rolling_mean + 1e-9, 6) AS rolling_mean, readings FROM x""")
def rolling_day_mean(spark, sf_dir):
    return rolling.rolling_mean(base.measurements(spark, sf_dir), ["location_id", "parameter"])


@query("index_from_band_table", "JN-8 JN-3 SCL-M1 SCL-M3", f"""
WITH {M} SELECT seq, parameter, round(value + 1e-9, 6) AS value,
  CASE parameter WHEN 'pm25' THEN {base.pm25_sql('value')} WHEN 'o3' THEN {base.o3_sql('value')} END AS aqi FROM m""")
def index_from_band_table(spark, sf_dir):
    """The bands come from a table and are joined by cells; parameters without bands have no index."""
    m = base.measurements(spark, sf_dir).select("seq", "parameter", "value")
    return intervals.index_from_bands(m, intervals.index_bands(spark))
