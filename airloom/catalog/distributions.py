"""Histogram, box-plot and violin queries."""

from __future__ import annotations

from airloom import fixed_values as fixed
from airloom.catalog import base
from airloom.catalog.base import LM, M, OM, query
from airloom.catalog.statistics import calendar_sql
from airloom.operators import distribution
from airloom.operators.quantiles import exact_quantiles


def histogram_sql(table: str) -> str:
    return f"""
rg AS (SELECT parameter, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
  CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM {table} GROUP BY 1),
c AS (SELECT parameter, least(floor(50 * (value - lo) / (hi - lo))::BIGINT + 1, 50) AS bin, count(*) AS n FROM {table} JOIN rg USING (parameter) GROUP BY 1, 2),
f AS (SELECT parameter, lo, hi, b AS bin FROM rg, range(1, 51) t(b)),
h AS (SELECT parameter, bin, round(lo + (hi - lo) / 50 * (bin - 1) + 1e-9, 6) AS bin_start, round(lo + (hi - lo) / 50 * bin + 1e-9, 6) AS bin_end,
  coalesce(n, 0)::BIGINT AS n FROM f LEFT JOIN c USING (parameter, bin))"""


@query("histogram", "AGG-19", f"WITH {M}, {histogram_sql('m')} SELECT * FROM h")
def histogram(spark, sf_dir):
    return distribution.histogram(base.measurements(spark, sf_dir), ["parameter"])


@query("line_price_histogram", "AGG-19", f"WITH {LM}, {histogram_sql('lm')} SELECT * FROM h")
def line_price_histogram(spark, sf_dir):
    return distribution.histogram(base.line_readings(spark, sf_dir), ["parameter"])


BOX = """
qt AS (SELECT parameter, unit, time_period, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM pr GROUP BY 1, 2, 3)"""
BOX_SELECT = """
SELECT parameter, unit, time_period, count(*) AS n, round(q1 + 1e-9, 6) AS q1, round(median + 1e-9, 6) AS median, round(q3 + 1e-9, 6) AS q3,
  round(least(q1, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1))) + 1e-9, 6) AS whisker_low,
  round(greatest(q3, max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1))) + 1e-9, 6) AS whisker_high,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM pr JOIN qt USING (parameter, unit, time_period) GROUP BY parameter, unit, time_period, q1, median, q3"""


@query("box_plots_daily", "AGG-20 JN-9 CH-6", f"WITH {M}, {calendar_sql('m', 30)}, {BOX} {BOX_SELECT}")
def box_plots_daily(spark, sf_dir):
    return distribution.box_summary(base.measurements(spark, sf_dir))


@query("box_plots_monthly", "AGG-20 JN-9 CH-6 WIN-2", f"WITH {OM}, {calendar_sql('om', 30)}, {BOX} {BOX_SELECT}")
def box_plots_monthly(spark, sf_dir):
    return distribution.box_summary(base.order_readings(spark, sf_dir), keep=fixed.BOX_PERIODS)


@query("box_outliers", "AGG-20 JN-9", f"""
WITH {M}, {calendar_sql('m', 30)}, {BOX} SELECT seq, location_id, parameter, unit, time_period, round(value + 1e-9, 6) AS value
FROM pr JOIN qt USING (parameter, unit, time_period) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def box_outliers(spark, sf_dir):
    return distribution.box_outliers(base.measurements(spark, sf_dir))


@query("violin_quartiles", "AGG-21 CH-7", f"""
WITH {M}, {calendar_sql('m', 20)}, {BOX} SELECT parameter, unit, time_period, round(q1 + 1e-9, 6) AS q1, round(median + 1e-9, 6) AS median, round(q3 + 1e-9, 6) AS q3 FROM qt""")
def violin_quartiles(spark, sf_dir):
    return distribution.violin_quartiles(base.measurements(spark, sf_dir))


def violin_sql(table: str) -> str:
    return f"""
{calendar_sql(table, 20)},
g AS (SELECT parameter, unit, time_period, count(*) AS n, min(value) AS lo, max(value) AS hi,
  stddev_samp(value) * pow(count(*), -0.2) AS bw FROM pr GROUP BY 1, 2, 3 HAVING stddev_samp(value) > 0),
gp AS (SELECT g.*, p AS point, lo - 2 * bw + (hi - lo + 4 * bw) / 99 * p AS x FROM g, range(0, 100) t(p))
SELECT parameter, unit, time_period, n, round(any_value(bw) + 1e-9, 6) AS bandwidth, point, round(any_value(x) + 1e-9, 6) AS x,
  round(sum(exp(-0.5::DOUBLE * ((x - value) / bw) * ((x - value) / bw))) / (n * any_value(bw) * sqrt(2 * pi())) + 1e-9, 6) AS density
FROM pr JOIN gp USING (parameter, unit, time_period) GROUP BY parameter, unit, time_period, n, point"""


@query("violin_density", "AGG-21 CH-7", f"WITH {M}, {violin_sql('m')}")
def violin_density(spark, sf_dir):
    return distribution.violin_density(base.measurements(spark, sf_dir))


def binned_violin_sql(table: str, keep: int) -> str:
    return f"""
{calendar_sql(table, keep)},
g AS (SELECT parameter, unit, time_period, count(*) AS n, min(value) AS lo, max(value) AS hi,
  stddev_samp(value) * pow(count(*), -0.2) AS bw FROM pr GROUP BY 1, 2, 3 HAVING stddev_samp(value) > 0),
gp AS (SELECT g.*, p AS point, lo - 2 * bw + (hi - lo + 4 * bw) / 99 * p AS x FROM g, range(0, 100) t(p)),
pl AS (SELECT parameter, unit, time_period, (value - lo) / bw * 16 AS place FROM pr JOIN g USING (parameter, unit, time_period)),
bn AS (SELECT parameter, unit, time_period, floor(place) AS bin, count(*) AS copies, sum(place - floor(place)) AS to_next FROM pl GROUP BY 1, 2, 3, 4)
SELECT parameter, unit, time_period, n, round(any_value(bw) + 1e-9, 6) AS bandwidth, point, round(any_value(x) + 1e-9, 6) AS x,
  round(sum((copies - to_next) * exp(-0.5::DOUBLE * pow((x - lo) / bw - bin / 16, 2)) + to_next * exp(-0.5::DOUBLE * pow((x - lo) / bw - (bin + 1) / 16, 2)))
    / (n * any_value(bw) * sqrt(2 * pi())) + 1e-9, 6) AS density
FROM bn JOIN gp USING (parameter, unit, time_period) GROUP BY parameter, unit, time_period, n, point"""


@query("binned_violin_density", "AGG-21 CH-7", f"WITH {M}, {binned_violin_sql('m', 20)}")
def binned_violin_density(spark, sf_dir):
    return distribution.binned_density(base.measurements(spark, sf_dir))


@query("line_price_density", "AGG-21", f"WITH {LM}, {binned_violin_sql('lm', 10**6)}")
def line_price_density(spark, sf_dir):
    return distribution.binned_density(base.line_readings(spark, sf_dir))


@query("line_price_quantiles", "AGG-20 AGG-2", f"""
WITH {LM} SELECT parameter, round(quantile_cont(value, 0.05) + 1e-9, 6) AS p05, round(quantile_cont(value, 0.25) + 1e-9, 6) AS p25,
  round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50, round(quantile_cont(value, 0.99) + 1e-9, 6) AS p99 FROM lm GROUP BY 1""")
def line_price_quantiles(spark, sf_dir):
    return exact_quantiles(
        base.line_readings(spark, sf_dir), ["parameter"], "value", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    )


@query("place_parameter_quartiles", "AGG-20", f"""
WITH {M} SELECT location_id, parameter, round(quantile_cont(value, 0.25) + 1e-9, 6) AS q1, round(quantile_cont(value, 0.5) + 1e-9, 6) AS median,
  round(quantile_cont(value, 0.75) + 1e-9, 6) AS q3 FROM m GROUP BY 1, 2""")
def place_parameter_quartiles(spark, sf_dir):
    return exact_quantiles(
        base.measurements(spark, sf_dir), ["location_id", "parameter"], "value", distribution.QUARTILES
    )
