"""Drift and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.catalog import base
from airloom.catalog.base import M, query
from airloom.operators import aggregates, drift, models

SPLIT = "datetime_utc >= TIMESTAMP_NTZ '2024-01-16 00:00:00'"
CURRENT = "datetime_utc >= TIMESTAMP '2024-01-16'"


@query("ks_drift", "ML-3", f"""
WITH {M}, s AS (SELECT parameter, value, {CURRENT} AS cur FROM m),
n AS (SELECT parameter, count(*) FILTER (WHERE NOT cur) AS nb, count(*) FILTER (WHERE cur) AS nc FROM s GROUP BY 1),
v AS (SELECT parameter, value, count(*) FILTER (WHERE NOT cur) AS b, count(*) FILTER (WHERE cur) AS c FROM s GROUP BY 1, 2),
r AS (SELECT parameter, sum(b) OVER w AS sb, sum(c) OVER w AS sc FROM v WINDOW w AS (PARTITION BY parameter ORDER BY value))
SELECT parameter, nb AS n_baseline, nc AS n_current, round(max(abs(sb::DOUBLE / nb - sc::DOUBLE / nc)) + 1e-9, 6) AS ks FROM r JOIN n USING (parameter) GROUP BY 1, 2, 3""")
def ks_drift(spark, sf_dir):
    return drift.ks_statistic(base.measurements(spark, sf_dir), F.expr(SPLIT))


@query("ks_test", "ML-3", f"""
WITH {M}, s AS (SELECT parameter, value, {CURRENT} AS cur FROM m),
n AS (SELECT parameter, count(*) FILTER (WHERE NOT cur)::DOUBLE AS nb, count(*) FILTER (WHERE cur)::DOUBLE AS nc FROM s GROUP BY 1),
v AS (SELECT parameter, value, count(*) FILTER (WHERE NOT cur) AS b, count(*) FILTER (WHERE cur) AS c FROM s GROUP BY 1, 2),
r AS (SELECT parameter, sum(b) OVER w AS sb, sum(c) OVER w AS sc FROM v WINDOW w AS (PARTITION BY parameter ORDER BY value)),
d AS (SELECT parameter, nb, nc, max(abs(sb / nb - sc / nc)) AS ks FROM r JOIN n USING (parameter) GROUP BY 1, 2, 3),
x AS (SELECT *, (sqrt(nb * nc / (nb + nc)) + 0.12 + 0.11 / sqrt(nb * nc / (nb + nc))) * ks AS x FROM d),
p AS (SELECT *, CASE WHEN x < 0.25 THEN 1 ELSE least(greatest((SELECT sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * j * j * x * x)) FROM range(1, 101) AS t(j)), 0), 1) END AS p FROM x)
SELECT parameter, nb::BIGINT AS n_baseline, nc::BIGINT AS n_current, round(ks + 1e-9, 6) AS ks, round(p::DOUBLE + 1e-9, 6) AS p_value, p < 0.05 AS drifted FROM p""")
def ks_test(spark, sf_dir):
    return drift.ks_test(base.measurements(spark, sf_dir), F.expr(SPLIT))


@query("population_stability", "ML-4", f"""
WITH {M}, s AS (SELECT parameter, value, {CURRENT} AS cur FROM m),
q AS (SELECT parameter, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM s WHERE NOT cur GROUP BY 1),
p AS (SELECT parameter, cur, (value > cuts[1])::INT + (value > cuts[2])::INT + (value > cuts[3])::INT + (value > cuts[4])::INT + (value > cuts[5])::INT
  + (value > cuts[6])::INT + (value > cuts[7])::INT + (value > cuts[8])::INT + (value > cuts[9])::INT AS bucket FROM s JOIN q USING (parameter)),
c AS (SELECT parameter, bucket, count(*) FILTER (WHERE NOT cur) AS b, count(*) FILTER (WHERE cur) AS c FROM p GROUP BY 1, 2),
f AS (SELECT parameter, greatest(b / sum(b) OVER w, 1e-6) AS pb, greatest(c / sum(c) OVER w, 1e-6) AS pc FROM c WINDOW w AS (PARTITION BY parameter))
SELECT parameter, round(sum((pc - pb) * ln(pc / pb)) + 1e-9, 6) AS psi FROM f GROUP BY 1""")
def population_stability(spark, sf_dir):
    return drift.population_stability(base.measurements(spark, sf_dir), F.expr(SPLIT))


@query("retrain_triggers", "ML-5", f"""
WITH {M}, d AS (SELECT location_id, datetime_local::DATE AS date, avg(value) AS v FROM m WHERE parameter = 'pm25' GROUP BY 1, 2),
e AS (SELECT a.location_id, a.date, a.v AS actual, b.v AS prediction, abs(b.v - a.v) AS error FROM d a JOIN d b ON a.location_id = b.location_id AND a.date = b.date + 1),
w AS (SELECT *, avg(error) OVER (PARTITION BY location_id ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS recent,
  avg(error) OVER (PARTITION BY location_id ORDER BY date) AS so_far FROM e)
SELECT location_id, date::VARCHAR AS date, round(actual + 1e-9, 6) AS actual, round(prediction + 1e-9, 6) AS prediction, round(error + 1e-9, 6) AS error,
  round(recent + 1e-9, 6) AS recent_error, round(so_far + 1e-9, 6) AS mean_error, recent > so_far * 1.2 AS retrain FROM w""")
def retrain_triggers(spark, sf_dir):
    daily = aggregates.daily_means(base.measurements(spark, sf_dir).where("parameter = 'pm25'")).drop("parameter")
    return drift.error_drift(drift.previous_day_forecast(daily), factor=1.2)


@query("error_changes", "ML-5", f"""
WITH {M}, d AS (SELECT location_id, datetime_local::DATE AS date, avg(value) AS v FROM m WHERE parameter = 'pm25' GROUP BY 1, 2),
e AS (SELECT a.location_id, a.date, a.v AS actual, b.v AS prediction, abs(b.v - a.v) AS error FROM d a JOIN d b ON a.location_id = b.location_id AND a.date = b.date + 1),
a AS (SELECT *, avg(error) OVER (PARTITION BY location_id ORDER BY date) AS mean FROM e),
s AS (SELECT *, sum(error - 1.1::DOUBLE * mean) OVER (PARTITION BY location_id ORDER BY date) AS total FROM a),
x AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY location_id ORDER BY date)) AS excess FROM s),
c AS (SELECT *, excess > 1.5::DOUBLE * mean AS changed, max(CASE WHEN excess = 0 THEN date END) OVER (PARTITION BY location_id ORDER BY date) AS since FROM x),
l AS (SELECT *, max(CASE WHEN changed THEN date END) OVER (PARTITION BY location_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM c)
SELECT location_id, date::VARCHAR AS date, round(actual + 1e-9, 6) AS actual, round(prediction + 1e-9, 6) AS prediction, round(error + 1e-9, 6) AS error,
  round(mean + 1e-9, 6) AS mean_error, round(excess + 1e-9, 6) AS excess, changed, since::VARCHAR AS since, changed AND coalesce(last < since, TRUE) AS alarm FROM l""")
def error_changes(spark, sf_dir):
    daily = aggregates.daily_means(base.measurements(spark, sf_dir).where("parameter = 'pm25'")).drop("parameter")
    return drift.error_changes(drift.previous_day_forecast(daily))


@query("feature_table", "ML-2 WIN-7 PRJ-2", f"""
WITH {M}, p AS (SELECT location_id, datetime_utc, datetime_local, arg_min(value, seq) FILTER (WHERE parameter = 'pm25') AS pm25,
  arg_min(value, seq) FILTER (WHERE parameter = 'temperature') AS temperature, arg_min(value, seq) FILTER (WHERE parameter = 'relativehumidity') AS relativehumidity
  FROM m GROUP BY 1, 2, 3),
r AS (SELECT DISTINCT location_id, datetime_utc, sum(value) OVER w / count(value) OVER w AS rolling_mean FROM m WHERE parameter = 'pm25'
  WINDOW w AS (PARTITION BY location_id ORDER BY datetime_utc RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW))
SELECT location_id, datetime_utc::VARCHAR AS datetime_utc, datetime_local::VARCHAR AS datetime_local, round(pm25 + 1e-9, 6) AS pm25,
  round(temperature + 1e-9, 6) AS temperature, round(relativehumidity + 1e-9, 6) AS relativehumidity, hour(datetime_local)::BIGINT AS hour,
  (isodow(datetime_local) - 1)::BIGINT AS day_of_week, round(rolling_mean + 1e-9, 6) AS rolling_mean FROM p LEFT JOIN r USING (location_id, datetime_utc)""")
def feature_table(spark, sf_dir):
    return models.feature_table(base.measurements(spark, sf_dir))


@query("linear_baseline", "ML-6", f"""
WITH {M}, p AS (SELECT location_id, datetime_utc, datetime_local, arg_min(value, seq) FILTER (WHERE parameter = 'pm25') AS pm25,
  arg_min(value, seq) FILTER (WHERE parameter = 'temperature') AS temperature FROM m GROUP BY 1, 2, 3),
f AS (SELECT pm25, coalesce(temperature, (SELECT avg(temperature) FROM p WHERE pm25 IS NOT NULL)) AS t FROM p WHERE pm25 IS NOT NULL)
SELECT round(regr_slope(pm25, t), 4) AS slope, round(regr_intercept(pm25, t), 4) AS intercept, round(regr_r2(pm25, t), 4) AS r2, count(*) AS n FROM f""")
def linear_baseline(spark, sf_dir):
    rows = models.training_rows(base.measurements(spark, sf_dir))
    line = models.linear_baseline(rows, ["temperature"]).stages[-1]
    return rows.agg(
        F.lit(round(float(line.coefficients[0]), 4)).alias("slope"), F.lit(round(float(line.intercept), 4)).alias("intercept"),
        F.lit(round(float(line.summary.r2), 4)).alias("r2"), F.count(F.lit(1)).alias("n"),
    )


@query("random_forest_forecast", "ML-1")
def random_forest_forecast(spark, sf_dir):
    """PM2.5 of the next 24 hours of every location, from hour, weekday, temperature and humidity."""
    rows = models.training_rows(base.measurements(spark, sf_dir))
    predicted = models.random_forest(rows).transform(models.coming_hours(rows))
    return predicted.select("location_id", "datetime_utc", "hours_ahead", "prediction")


LABELLED = f"""{M}, y AS (SELECT location_id, datetime_utc, arg_min(value, seq) AS pm25 FROM m WHERE parameter = 'pm25' AND value IS NOT NULL GROUP BY 1, 2)"""


@query("forecast_in_range", "ML-1", f"""
WITH {LABELLED} SELECT location_id, (max(datetime_utc) + h * INTERVAL 1 HOUR)::VARCHAR AS datetime_utc, h AS hours_ahead, TRUE AS is_in_range
FROM y, range(1, 25) t(h) GROUP BY location_id, h""")
def forecast_in_range(spark, sf_dir):
    """The forecast's hours, and whether each prediction lies between the least and greatest label, as a forest's must."""
    rows = models.training_rows(base.measurements(spark, sf_dir))
    predicted = models.random_forest(rows).transform(models.coming_hours(rows))
    least, greatest = (rows.agg(f("pm25")).scalar() for f in (F.min, F.max))
    return predicted.select("location_id", "datetime_utc", "hours_ahead", F.col("prediction").between(least, greatest).alias("is_in_range"))


@query("forest_holdout", "ML-1", f"""
WITH {LABELLED}, e AS (SELECT max(datetime_utc) - INTERVAL 24 HOUR AS cut FROM y)
SELECT location_id, count(*) AS n, max(pm25) IS NOT NULL AS is_scored, round(avg(pm25) + 1e-9, 6) AS mean FROM y, e WHERE datetime_utc > cut GROUP BY 1""")
def forest_holdout(spark, sf_dir):
    """The last day of the data, predicted by a forest that has not seen it: rows and true mean of every location."""
    known, held = models.split_by_time(models.training_rows(base.measurements(spark, sf_dir)))
    scored = models.random_forest(known).transform(held)
    return scored.groupBy("location_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction").isNotNull()).alias("is_scored"), F.avg("pm25").alias("mean"))
