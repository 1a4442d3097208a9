"""Group-by statistics of measurements and AQI records."""

from __future__ import annotations

from airloom.catalog import base
from airloom.catalog.base import A, LM, M, OM, query
from airloom.operators import aggregates, periods
from pyspark.sql import functions as F


@query("dataset_overview", "AGG-1 SCL-S4", f"""
WITH {M} SELECT count(*) AS records, count(DISTINCT location_id) AS locations, count(DISTINCT parameter) AS n_parameters,
  (SELECT string_agg(parameter, ', ' ORDER BY parameter) FROM (SELECT DISTINCT parameter FROM m)) AS parameters,
  min(datetime_local)::VARCHAR AS first_local, max(datetime_local)::VARCHAR AS last_local FROM m""")
def dataset_overview(spark, sf_dir):
    return aggregates.overview(base.measurements(spark, sf_dir))


@query("parameter_stats", "AGG-2 AGG-3", f"""
WITH {M} SELECT parameter, arg_min(units, seq) AS units, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean,
  round(min(value) + 1e-9, 6) AS min, round(max(value) + 1e-9, 6) AS max, round(stddev_samp(value) + 1e-9, 6) AS std,
  round(median(value) + 1e-9, 6) AS median FROM m GROUP BY parameter""")
def parameter_stats(spark, sf_dir):
    return aggregates.parameter_stats(base.measurements(spark, sf_dir))


@query("line_price_stats", "AGG-2", f"""
WITH {LM} SELECT parameter, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, round(min(value) + 1e-9, 6) AS min, round(max(value) + 1e-9, 6) AS max,
  round(stddev_samp(value) + 1e-9, 6) AS std, round(median(value) + 1e-9, 6) AS median FROM lm GROUP BY parameter""")
def line_price_stats(spark, sf_dir):
    lines = base.line_readings(spark, sf_dir).withColumns({"units": F.lit(None).cast("string"), "seq": F.col("l_orderkey")})
    return aggregates.parameter_stats(lines).drop("units")


@query("location_profile", "AGG-4 AGG-5", f"""
WITH {M}, q AS (SELECT location_id, string_agg(parameter, ', ' ORDER BY parameter) AS parameters
  FROM (SELECT DISTINCT location_id, parameter FROM m) GROUP BY location_id)
SELECT location_id, count(*) AS records, any_value(q.parameters) AS parameters, min(datetime_local)::VARCHAR AS first_local,
  max(datetime_local)::VARCHAR AS last_local, round(avg(value) FILTER (WHERE parameter = 'pm25') + 1e-9, 6) AS pm25_mean,
  round(max(value) FILTER (WHERE parameter = 'pm25') + 1e-9, 6) AS pm25_max
FROM m JOIN q USING (location_id) GROUP BY location_id""")
def location_profile(spark, sf_dir):
    return aggregates.location_profile(base.measurements(spark, sf_dir))


@query("distinct_parameters", "AGG-29 SRT-3", f"WITH {M} SELECT DISTINCT parameter FROM m")
def distinct_parameters(spark, sf_dir):
    return aggregates.distinct_parameters(base.measurements(spark, sf_dir)).orderBy("parameter")


@query("records_per_location", "AGG-31", f"WITH {M} SELECT location_id, count(*) AS n FROM m GROUP BY location_id")
def records_per_location(spark, sf_dir):
    return aggregates.records_per_location(base.measurements(spark, sf_dir))


@query("daily_means", "AGG-6", f"""
WITH {M} SELECT parameter, location_id, datetime_local::DATE::VARCHAR AS date, round(avg(value) + 1e-9, 6) AS mean
FROM m GROUP BY parameter, location_id, datetime_local::DATE""")
def daily_means(spark, sf_dir):
    return aggregates.daily_means(base.measurements(spark, sf_dir))


@query("daily_pm25_utc", "AGG-32", f"""
WITH {M} SELECT datetime_utc::DATE::VARCHAR AS date, round(avg(value) + 1e-9, 6) AS mean FROM m WHERE parameter = 'pm25' GROUP BY 1""")
def daily_pm25_utc(spark, sf_dir):
    return aggregates.daily_pm25_utc(base.measurements(spark, sf_dir))


def _means(table: str, by: str) -> str:
    cells = ", ".join(f"round(avg(value) FILTER (WHERE parameter = '{p}') + 1e-9, 6) AS {p}" for p in base.PARAMETERS)
    return f"SELECT {by}, {cells} FROM {table} GROUP BY ALL"


@query("location_parameter_means", "AGG-7", f"WITH {M} {_means('m', 'location_id')}")
def location_parameter_means(spark, sf_dir):
    return aggregates.location_parameter_means(base.measurements(spark, sf_dir), base.PARAMETERS)


@query("aligned_means", "AGG-9 JN-6", f"WITH {M} {_means('m', 'location_id, datetime_utc::VARCHAR AS datetime_utc')}")
def aligned_means(spark, sf_dir):
    from airloom.operators.pivot import pivot_mean

    return pivot_mean(base.measurements(spark, sf_dir), base.PARAMETERS, ["location_id", "datetime_utc"])


@query("pm25_hotspots", "AGG-33 LIM-3", f"""
WITH {M} SELECT location_id, round(coalesce(avg(value) FILTER (WHERE parameter = 'pm25'), 0) + 1e-9, 6) AS pm25_mean FROM m
GROUP BY location_id ORDER BY coalesce(avg(value) FILTER (WHERE parameter = 'pm25'), 0) DESC, location_id LIMIT 5""")
def pm25_hotspots(spark, sf_dir):
    return aggregates.hotspots(base.measurements(spark, sf_dir))


_PAIRS = [
    ("pm25", "pm1"), ("pm25", "temperature"), ("relativehumidity", "temperature"),
    ("pm25", "relativehumidity"), ("pm1", "temperature"), ("pm1", "relativehumidity"),
]
CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{a}' AS parameter_x, '{b}' AS parameter_y, round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END + 1e-9, 6) AS correlation, "
    f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS samples FROM w"
    for a, b in _PAIRS
)
WIDE = "w AS (SELECT location_id, datetime_utc, " + ", ".join(
    f"avg(value) FILTER (WHERE parameter = '{p}') AS {p}" for p in base.PARAMETERS
) + " FROM m GROUP BY location_id, datetime_utc)"


@query("pair_correlations", "AGG-18 FLT-4", f"WITH {M}, {WIDE} SELECT * FROM ({CORRELATIONS}) WHERE samples > 0")
def pair_correlations(spark, sf_dir):
    return aggregates.pair_correlations(base.measurements(spark, sf_dir))


@query("aqi_overview", "AGG-10", f"""
WITH {A} SELECT count(aqi_overall) AS n, round(avg(aqi_overall) + 1e-9, 6) AS mean_aqi, max(aqi_overall) AS max_aqi FROM a""")
def aqi_overview(spark, sf_dir):
    return aggregates.aqi_overview(base.aqi(spark, sf_dir))


LOCATION_AQI = f"""
WITH {A}, l AS (SELECT location_id, avg(aqi_overall) AS v FROM a GROUP BY location_id)
SELECT location_id, round(v + 1e-9, 6) AS mean_aqi, {base.category_sql('v')} AS category, {base.color_sql('v')} AS color FROM l"""


@query("aqi_by_location", "AGG-11 SCL-M5", LOCATION_AQI)
def aqi_by_location(spark, sf_dir):
    return aggregates.aqi_by_location(base.aqi(spark, sf_dir))


@query("aqi_category_share", "AGG-12 WIN-8 SRT-4 SCL-M7", f"""
WITH {A} SELECT aqi_category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () + 1e-9, 6) AS share
FROM a GROUP BY aqi_category""")
def aqi_category_share(spark, sf_dir):
    return aggregates.category_share(base.aqi(spark, sf_dir))


@query("daily_aqi_category_share", "AGG-13", f"""
WITH {A}, d AS (SELECT datetime_local::DATE AS date, avg(aqi_overall) AS v FROM a GROUP BY 1),
c AS (SELECT {base.category_sql('v')} AS aqi_category FROM d)
SELECT aqi_category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () + 1e-9, 6) AS share FROM c GROUP BY aqi_category""")
def daily_aqi_category_share(spark, sf_dir):
    return aggregates.daily_category_share(base.aqi(spark, sf_dir))


@query("daily_aqi", "AGG-15 PRJ-4 STR-6", f"""
WITH {A} SELECT location_id, datetime_local::DATE::VARCHAR AS date, round(avg(aqi_overall) + 1e-9, 6) AS aqi FROM a GROUP BY 1, 2""")
def daily_aqi(spark, sf_dir):
    return aggregates.daily_aqi(base.aqi(spark, sf_dir))


@query("hourly_aqi", "AGG-16", f"""
WITH {A} SELECT location_id, hour(datetime_local)::BIGINT AS hour, round(avg(aqi_overall) + 1e-9, 6) AS aqi FROM a GROUP BY 1, 2""")
def hourly_aqi(spark, sf_dir):
    return aggregates.hourly_aqi(base.aqi(spark, sf_dir))


PERIODS = f"""
WITH {A}, f AS (SELECT min(datetime_local)::DATE AS d0 FROM a),
n AS (SELECT a.*, (datetime_local::DATE - d0) // 15 AS period_num, d0 FROM a, f),
g AS (SELECT location_id, period_num, d0, avg(aqi_overall) AS v FROM n GROUP BY 1, 2, 3)"""


@query("period_aqi", "AGG-17 SCL-D10", f"""{PERIODS}
SELECT location_id, period_num, strftime(d0 + CAST(period_num * 15 AS INTEGER), '%m/%d') || '-' ||
  strftime(d0 + CAST(period_num * 15 + 14 AS INTEGER), '%m/%d') AS period, round(v + 1e-9, 6) AS aqi FROM g""")
def period_aqi(spark, sf_dir):
    return aggregates.period_aqi(base.aqi(spark, sf_dir))


@query("period_order", "AGG-30 JN-7", f"""{PERIODS},
q AS (SELECT period_num, d0, min(datetime_local)::DATE AS earliest FROM n GROUP BY 1, 2)
SELECT period_num, strftime(d0 + CAST(period_num * 15 AS INTEGER), '%m/%d') || '-' ||
  strftime(d0 + CAST(period_num * 15 + 14 AS INTEGER), '%m/%d') AS period, earliest::VARCHAR AS earliest,
  row_number() OVER (ORDER BY period_num) - 1 AS period_order FROM q""")
def period_order(spark, sf_dir):
    return aggregates.period_order(base.aqi(spark, sf_dir))


SPAN = """floor(epoch(max(datetime_local) - min(datetime_local)) / 86400)::BIGINT"""


@query("time_spans", "AGG-27 SCL-D9", f"""
WITH {M}, {OM}, s AS (SELECT parameter, {SPAN} AS span_days FROM m GROUP BY 1
  UNION ALL SELECT parameter, {SPAN} FROM om GROUP BY 1)
SELECT *, CASE WHEN span_days > 365 THEN 'Month' WHEN span_days > 60 THEN 'Week' ELSE 'Day' END AS unit FROM s""")
def time_spans(spark, sf_dir):
    cols = ["parameter", "datetime_local"]
    both = base.measurements(spark, sf_dir).select(*cols).unionByName(base.order_readings(spark, sf_dir).select(*cols))
    return aggregates.time_spans(both)


@query("high_watermarks", "AGG-26", f"""
WITH {M} SELECT location_id, max(datetime_to_utc)::VARCHAR AS last_fetch_time FROM m GROUP BY 1""")
def high_watermarks(spark, sf_dir):
    return aggregates.high_watermarks(base.measurements(spark, sf_dir))


@query("first_and_last_record", "WIN-5", f"""
WITH {M} SELECT location_id, arg_min(datetime_local, (datetime_utc, seq))::VARCHAR AS first_local,
  arg_max(datetime_local, (datetime_utc, seq))::VARCHAR AS last_local FROM m GROUP BY 1""")
def first_and_last_record(spark, sf_dir):
    return aggregates.first_and_last(base.measurements(spark, sf_dir))


@query("error_rate_by_location", "AGG-34", f"""
WITH {M} SELECT location_id, count(*) AS total, count(*) FILTER (WHERE parameter = 'o3' AND value > 0.05) AS errors,
  round(count(*) FILTER (WHERE parameter = 'o3' AND value > 0.05)::DOUBLE / count(*) + 1e-9, 6) AS error_rate FROM m GROUP BY 1""")
def error_rate_by_location(spark, sf_dir):
    failed = (F.col("parameter") == "o3") & (F.col("value") > 0.05)
    return aggregates.error_rate(base.measurements(spark, sf_dir), failed, "location_id")


CALENDAR = """
sp AS (SELECT parameter, {span} AS span_days FROM {t} GROUP BY 1),
lb AS (SELECT t.*, CASE WHEN span_days > 365 THEN 'Month' WHEN span_days > 60 THEN 'Week' ELSE 'Day' END AS unit,
  CASE WHEN span_days > 365 THEN strftime(datetime_local, '%Y-%m')
    WHEN span_days > 60 THEN date_trunc('week', datetime_local)::DATE::VARCHAR || '/' || (date_trunc('week', datetime_local)::DATE + 6)::VARCHAR
    ELSE datetime_local::DATE::VARCHAR END AS time_period FROM {t} t JOIN sp USING (parameter)),
rk AS (SELECT parameter, time_period, row_number() OVER (PARTITION BY parameter ORDER BY time_period) - 1 AS r,
  count(*) OVER (PARTITION BY parameter) AS n FROM (SELECT DISTINCT parameter, time_period FROM lb)),
kp AS (SELECT parameter, time_period FROM rk WHERE n <= {keep} OR r % (n // {keep}) = 0),
pr AS (SELECT lb.* FROM lb JOIN kp USING (parameter, time_period))"""


def calendar_sql(table: str, keep: int) -> str:
    return CALENDAR.format(span=SPAN, t=table, keep=keep)


@query("sampled_periods", "SCL-D9 WIN-2", f"""
WITH {OM}, {calendar_sql('om', 30)} SELECT parameter, unit, time_period, count(*) AS n FROM pr GROUP BY ALL""")
def sampled_periods(spark, sf_dir):
    kept = periods.with_periods(base.order_readings(spark, sf_dir), 30)
    return kept.groupBy("parameter", "unit", "time_period").agg(F.count(F.lit(1)).alias("n"))


@query("rows_of_sampled_periods", "JN-4", f"""
WITH {M}, {calendar_sql('m', 20)} SELECT seq, parameter, unit, time_period FROM pr""")
def rows_of_sampled_periods(spark, sf_dir):
    return periods.with_periods(base.measurements(spark, sf_dir), 20).select("seq", "parameter", "unit", "time_period")
