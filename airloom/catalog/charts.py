"""Chart datasets and the summary report."""

from __future__ import annotations

from airloom.catalog import base
from airloom.catalog.base import A, M, NAMES, query
from airloom.catalog.distributions import histogram_sql
from airloom.catalog.statistics import _PAIRS, PERIODS, WIDE
from airloom.plans import charts, report


@query("chart_histogram", "CH-1 AGG-3", f"""
WITH {M}, {histogram_sql('m')}, s AS (SELECT parameter, count(*) AS records, round(avg(value) + 1e-9, 6) AS mean,
  round(stddev_samp(value) + 1e-9, 6) AS std, round(median(value) + 1e-9, 6) AS median FROM m GROUP BY 1)
SELECT h.*, records, mean, std, median FROM h JOIN s USING (parameter)""")
def chart_histogram(spark, sf_dir):
    return charts.histogram_with_caption(base.measurements(spark, sf_dir))


@query("chart_scatter_points", "CH-2 FLT-4 AGG-9", f"WITH {M}, {WIDE} " + " UNION ALL ".join(
    f"SELECT location_id, datetime_utc::VARCHAR AS datetime_utc, '{a}' AS parameter_x, '{b}' AS parameter_y, round({a} + 1e-9, 6) AS x, round({b} + 1e-9, 6) AS y "
    f"FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS))
def chart_scatter_points(spark, sf_dir):
    return charts.scatter_points(base.measurements(spark, sf_dir))


@query("chart_series_by_parameter", "CH-3 SRT-2 FLT-2", f"""
WITH {M}, {NAMES} SELECT parameter, m.location_id, {base.name_sql('m')} AS location_name, datetime_local::VARCHAR AS datetime_local, seq,
  round(value + 1e-9, 6) AS value, units, CASE WHEN parameter = 'pm25' THEN 15.0::DOUBLE END AS guideline,
  CASE WHEN parameter = 'pm25' THEN value > 15 END AS exceeds FROM m LEFT JOIN nm USING (location_id)""")
def chart_series_by_parameter(spark, sf_dir):
    return charts.series_by_parameter(base.measurements(spark, sf_dir), base.location_names(spark, sf_dir))


@query("chart_series_by_location", "CH-4 SRT-2 FLT-3 SCL-S3", f"""
WITH {M}, {NAMES} SELECT {base.name_sql('m')} AS location_name, upper(parameter) AS panel, m.location_id, parameter,
  datetime_local::VARCHAR AS datetime_local, seq, round(value + 1e-9, 6) AS value, units FROM m LEFT JOIN nm USING (location_id)""")
def chart_series_by_location(spark, sf_dir):
    return charts.series_by_location(base.measurements(spark, sf_dir), base.location_names(spark, sf_dir))


@query("chart_daily_trend", "CH-5 AGG-6", f"""
WITH {M}, {NAMES}, d AS (SELECT parameter, location_id, datetime_local::DATE::VARCHAR AS date, round(avg(value) + 1e-9, 6) AS mean FROM m GROUP BY 1, 2, 3)
SELECT d.*, {base.name_sql('d')} AS location_name FROM d LEFT JOIN nm USING (location_id)""")
def chart_daily_trend(spark, sf_dir):
    return charts.daily_trend(base.measurements(spark, sf_dir), base.location_names(spark, sf_dir))


@query("chart_aqi_series", "CH-8 SCL-M6", f"""
WITH {A}, {NAMES} SELECT a.location_id, {base.name_sql('a')} AS location_name, datetime_local::VARCHAR AS datetime_local, aqi_overall, aqi_category,
  (CASE WHEN aqi_overall <= 50 THEN 50 WHEN aqi_overall <= 100 THEN 100 WHEN aqi_overall <= 150 THEN 150
    WHEN aqi_overall <= 200 THEN 200 WHEN aqi_overall <= 300 THEN 300 END)::BIGINT AS band_top
FROM a LEFT JOIN nm USING (location_id)""")
def chart_aqi_series(spark, sf_dir):
    return charts.aqi_series(base.aqi(spark, sf_dir), base.location_names(spark, sf_dir))


@query("chart_aqi_bars", "CH-9 AGG-11", f"""
WITH {A}, {NAMES}, l AS (SELECT location_id, avg(aqi_overall) AS v FROM a GROUP BY location_id)
SELECT location_id, round(v + 1e-9, 6) AS mean_aqi, {base.category_sql('v')} AS category, {base.color_sql('v')} AS color,
  {base.name_sql('l')} AS location_name FROM l LEFT JOIN nm USING (location_id)""")
def chart_aqi_bars(spark, sf_dir):
    return charts.aqi_bars(base.aqi(spark, sf_dir), base.location_names(spark, sf_dir))


@query("chart_category_pies", "CH-10 AGG-12 AGG-13", f"""
WITH {A}, d AS (SELECT datetime_local::DATE AS date, avg(aqi_overall) AS v FROM a GROUP BY 1),
b AS (SELECT 'record' AS level, aqi_category FROM a UNION ALL SELECT 'day', {base.category_sql('v')} FROM d)
SELECT level, aqi_category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY level) + 1e-9, 6) AS share,
  CASE aqi_category WHEN 'Good' THEN 'green' WHEN 'Moderate' THEN 'yellow' WHEN 'Unhealthy for Sensitive Groups' THEN 'orange'
    WHEN 'Unhealthy' THEN 'red' WHEN 'Very Unhealthy' THEN 'purple' WHEN 'Hazardous' THEN 'maroon' ELSE 'gray' END AS color
FROM b GROUP BY level, aqi_category""")
def chart_category_pies(spark, sf_dir):
    return charts.category_pies(base.aqi(spark, sf_dir))


@query("chart_aqi_heatmap", "CH-11 AGG-14 WIN-2", f"""
WITH {A}, {NAMES}, c AS (SELECT location_id, datetime_local::DATE AS date, avg(aqi_overall) AS v FROM a GROUP BY 1, 2 HAVING avg(aqi_overall) IS NOT NULL),
d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM c))
SELECT c.location_id, c.date::VARCHAR AS date, round(v + 1e-9, 6) AS aqi, {base.name_sql('c')} AS location_name
FROM c JOIN d USING (date) LEFT JOIN nm USING (location_id) WHERE n <= 60 OR r % (n // 60) = 0""")
def chart_aqi_heatmap(spark, sf_dir):
    return charts.aqi_heatmap(base.aqi(spark, sf_dir), base.location_names(spark, sf_dir))


@query("chart_aqi_daily_trend", "CH-12 AGG-15", f"""
WITH {A}, {NAMES}, c AS (SELECT location_id, datetime_local::DATE AS date, avg(aqi_overall) AS v FROM a GROUP BY 1, 2)
SELECT c.location_id, date::VARCHAR AS date, round(v + 1e-9, 6) AS aqi, {base.name_sql('c')} AS location_name,
  {base.category_sql('v')} AS category, {base.color_sql('v')} AS band_color FROM c LEFT JOIN nm USING (location_id)""")
def chart_aqi_daily_trend(spark, sf_dir):
    return charts.aqi_daily_trend(base.aqi(spark, sf_dir), base.location_names(spark, sf_dir))


@query("chart_aqi_hour_profile", "CH-13 AGG-16", f"""
WITH {A}, {NAMES}, c AS (SELECT location_id, hour(datetime_local)::BIGINT AS hour, round(avg(aqi_overall) + 1e-9, 6) AS aqi FROM a GROUP BY 1, 2)
SELECT c.*, {base.name_sql('c')} AS location_name FROM c LEFT JOIN nm USING (location_id)""")
def chart_aqi_hour_profile(spark, sf_dir):
    return charts.aqi_hour_profile(base.aqi(spark, sf_dir), base.location_names(spark, sf_dir))


@query("chart_aqi_period_trend", "CH-14 AGG-17 AGG-30 JN-7 WIN-2", f"""{PERIODS}, {NAMES},
q AS (SELECT period_num, row_number() OVER (ORDER BY period_num) - 1 AS period_order, count(*) OVER () AS k FROM (SELECT DISTINCT period_num FROM n))
SELECT g.location_id, g.period_num, strftime(d0 + CAST(g.period_num * 15 AS INTEGER), '%m/%d') || '-' ||
  strftime(d0 + CAST(g.period_num * 15 + 14 AS INTEGER), '%m/%d') AS period, round(v + 1e-9, 6) AS aqi, period_order,
  period_order % greatest(k // 20, 1) = 0 AS is_tick, {base.name_sql('g')} AS location_name
FROM g JOIN q USING (period_num) LEFT JOIN nm USING (location_id)""")
def chart_aqi_period_trend(spark, sf_dir):
    return charts.aqi_period_trend(base.aqi(spark, sf_dir), base.location_names(spark, sf_dir))


_CELLS = ", ".join(f"round(avg(value) FILTER (WHERE parameter = '{p}') + 1e-9, 6) AS {p}" for p in base.PARAMETERS)


@query("chart_parameter_heatmap", "CH-15 AGG-7", f"""
WITH {M}, {NAMES} SELECT {base.name_sql('m')} AS location_name, {_CELLS} FROM m LEFT JOIN nm USING (location_id) GROUP BY 1""")
def chart_parameter_heatmap(spark, sf_dir):
    return charts.parameter_heatmap(
        base.measurements(spark, sf_dir), base.location_names(spark, sf_dir), base.PARAMETERS
    )


@query("chart_pm25_line", "CH-17 FLT-9 SRT-2", f"""
WITH {M} SELECT datetime_local::VARCHAR AS datetime_local, seq, round(value + 1e-9, 6) AS value FROM m
WHERE location_id = 5 AND parameter = 'pm25' AND datetime_utc > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def chart_pm25_line(spark, sf_dir):
    return charts.pm25_line(base.measurements(spark, sf_dir), 5, "2024-01-31 00:00:00")


RULE, THIN = "=" * 80, "-" * 80


@query("summary_report", "CH-16 SNK-6 SCL-S3 SCL-S4 SCL-S7", f"""
WITH {M}, {NAMES},
t AS (SELECT count(*) AS n, min(datetime_local)::VARCHAR AS d0, max(datetime_local)::VARCHAR AS d1 FROM m),
ps AS (SELECT parameter, arg_min(units, seq) AS units, count(*) AS n, avg(value) AS mean, median(value) AS med, min(value) AS lo,
  max(value) AS hi, stddev_samp(value) AS sd FROM m GROUP BY 1),
dp AS (SELECT location_id, string_agg(parameter, ', ' ORDER BY parameter) AS ps FROM (SELECT DISTINCT location_id, parameter FROM m) GROUP BY 1),
ls AS (SELECT location_id, any_value({base.name_sql('m')}) AS nme, count(*) AS n, min(datetime_local)::VARCHAR AS d0, max(datetime_local)::VARCHAR AS d1,
  avg(value) FILTER (WHERE parameter = 'pm25') AS pm, max(value) FILTER (WHERE parameter = 'pm25') AS px FROM m LEFT JOIN nm USING (location_id) GROUP BY 1),
b AS (
 SELECT 1 AS s, '' AS k, ['{RULE}', 'AIR QUALITY DATA ANALYTICS SUMMARY', '{RULE}', '', 'Generated: 2024-01-31 00:00:00',
   'Total Records: ' || format('{{:,}}', n), 'Date Range: ' || d0 || ' to ' || d1, 'Output Directory: analytics_output', '', '{RULE}', ''] AS lines FROM t
 UNION ALL SELECT 2, '', ['PARAMETER STATISTICS', '{THIN}']
 UNION ALL SELECT 3, parameter, ['', upper(parameter) || ' (' || units || '):', '  Count:   ' || format('{{:,}}', n), '  Mean:    ' || printf('%.2f', mean),
   '  Median:  ' || printf('%.2f', med), '  Min:     ' || printf('%.2f', lo), '  Max:     ' || printf('%.2f', hi), '  Std Dev: ' || printf('%.2f', sd)] FROM ps
 UNION ALL SELECT 4, '', ['', '{RULE}', '', 'LOCATION STATISTICS', '{THIN}']
 UNION ALL SELECT 5, lpad(location_id::VARCHAR, 20, '0'), ['', nme || ' (ID: ' || location_id || '):', '  Total Records: ' || format('{{:,}}', n), '  Parameters: ' || dp.ps,
   '  Date Range: ' || d0 || ' to ' || d1, '  PM2.5 Mean: ' || printf('%.2f', pm) || ' µg/m³', '  PM2.5 Max:  ' || printf('%.2f', px) || ' µg/m³']
   FROM ls JOIN dp USING (location_id)
 UNION ALL SELECT 6, '', ['', '{RULE}', '']),
u AS (SELECT s, k, unnest(lines) AS text, generate_subscripts(lines, 1) AS i FROM b)
SELECT row_number() OVER (ORDER BY s, k, i) AS line_no, text FROM u WHERE text IS NOT NULL""")
def summary_report(spark, sf_dir):
    return report.summary_report(
        base.measurements(spark, sf_dir), base.location_names(spark, sf_dir), "2024-01-31 00:00:00", "analytics_output"
    )
