"""Validation queries over records with damage that depends on ``props.k``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.catalog import base
from airloom.catalog.base import M, query
from airloom.functions import nested
from airloom.operators import quality
from airloom.plans import report
from airloom.plans.runs import quality_alerts

AS_OF = "2024-01-31 00:00:00"

# Which k damages what, the same in both engines:
#  3 no parameter          7 parameter as text      11 parameter without id
# 13 no value             17 value null             19 value as text
# 23 value times -1000       29 no period              31 period as text
# 37 no start time        41 ten years later        43 ten years earlier
# 47 unreadable time      53 bare year              59 no locationId
# 61 value times 1000


def damaged_records(spark, sf_dir) -> DataFrame:
    """(seq, location_id, record) with each record parsed from JSON text."""
    m = base.measurements(spark, sf_dir)
    k = F.col("k")

    def text(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    def obj(*fields: tuple[str, Column]) -> Column:
        parts = [F.concat(F.lit(f'"{name}":'), c) for name, c in fields]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    shown = F.when(k == 23, F.col("value") * -1000).when(k == 61, F.col("value") * 1000).otherwise(F.col("value")).cast("string")
    value = F.when(k == 17, F.lit("null")).when(k == 19, text(F.lit("bad"))).when(k != 13, shown)
    plain_id = F.when(k != 11, F.col("parameter_id").cast("string"))
    parameter = F.when(k == 7, text(F.col("parameter"))).when(
        k != 3, obj(("id", plain_id), ("name", text(F.col("parameter"))))
    )
    at = F.col("datetime_utc")
    years = F.when(k == 41, at + F.expr("INTERVAL 10 YEARS")).when(k == 43, at - F.expr("INTERVAL 10 YEARS")).otherwise(at)
    utc = F.when(k == 47, F.lit("yesterday")).when(k == 53, F.lit("2024")).otherwise(
        F.date_format(years, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    period = F.when(k == 31, text(F.lit("hour"))).when(k == 37, F.lit("{}")).when(
        k != 29, obj(("datetimeFrom", obj(("utc", text(utc)))))
    )
    place = F.when(k != 59, F.col("location_id").cast("string"))
    document = obj(("value", value), ("parameter", parameter), ("period", period), ("locationId", place))
    return m.select("seq", "location_id", F.try_parse_json(document).alias("record"))


def validated(spark, sf_dir) -> DataFrame:
    rules = quality.range_rules(spark)
    return quality.validate(damaged_records(spark, sf_dir), rules, AS_OF)


V = f"""{M},
c AS (SELECT seq, location_id, parameter, k,
  CASE WHEN k = 23 THEN value * -1000 WHEN k = 61 THEN value * 1000 ELSE value END AS v,
  CASE WHEN k = 41 THEN datetime_utc + INTERVAL 10 YEAR WHEN k = 43 THEN datetime_utc - INTERVAL 10 YEAR ELSE datetime_utc END AS moment,
  CASE WHEN parameter = 'temperature' THEN -50 ELSE 0 END AS lo,
  CASE parameter WHEN 'temperature' THEN 60 WHEN 'o3' THEN 500 ELSE 1000 END AS hi,
  parameter <> 'relativehumidity' AND k NOT IN (3, 7, 13, 17) AS ruled FROM m),
d AS (SELECT *, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS shown FROM c),
w AS (SELECT seq, location_id,
  concat_ws(' | ', CASE WHEN k = 13 THEN 'Missing required field: value' END, CASE WHEN k = 3 THEN 'Missing required field: parameter' END,
    CASE WHEN k = 29 THEN 'Missing required field: period' END, CASE WHEN k = 59 THEN 'Missing required field: locationId' END,
    CASE WHEN k = 7 THEN '''parameter'' must be a dictionary' WHEN k = 11 THEN '''parameter'' must have ''id'' and ''name'' fields' END,
    CASE WHEN k = 31 THEN '''period'' must be a dictionary' WHEN k = 37 THEN '''period'' must have ''datetimeFrom'' field' END,
    CASE WHEN k = 47 THEN 'Invalid timestamp format: yesterday' WHEN k = 53 THEN 'Invalid timestamp format: 2024' END,
    CASE WHEN k NOT IN (29, 31, 37, 47, 53) AND moment > TIMESTAMP '{AS_OF}' THEN 'Timestamp is in the future: ' || shown END,
    CASE WHEN k NOT IN (29, 31, 37, 47, 53) AND floor(epoch(TIMESTAMP '{AS_OF}' - moment) / 86400) > 1825 THEN 'Timestamp is older than 5 years: ' || shown END) AS errors,
  CASE WHEN NOT ruled THEN '' WHEN k = 19 THEN 'Value is not numeric: bad'
    WHEN v < lo OR v > hi THEN parameter || ' value ' || v || ' outside valid range [' || lo || ', ' || hi || ']' ELSE '' END AS warnings FROM d),
v AS (SELECT *, errors = '' AS valid FROM w)"""


@query("validated_records", "VAL-1 VAL-2 VAL-3 VAL-4 VAL-5 VAL-6 VAL-7 VAL-8 VAL-9 JN-3 SRC-7 SCL-J3 SCL-J4 SCL-J6 SCL-S6 SCL-S8 SCL-D11", f"""
WITH {V} SELECT seq, location_id, errors, warnings, valid FROM v""")
def validated_records(spark, sf_dir):
    return validated(spark, sf_dir).drop("record")


@query("field_presence", "SCL-J3 SCL-J4", f"""
WITH {M} SELECT seq, k <> 13 AS has_value, k = 17 AS value_is_null, k NOT IN (13, 17, 19) AS value_is_number,
  k NOT IN (3, 7) AS parameter_is_object, k NOT IN (3, 7, 11) AS has_parameter_id FROM m""")
def field_presence(spark, sf_dir):
    rec = F.col("record")
    value = nested.field(rec, "value")
    return damaged_records(spark, sf_dir).select(
        "seq", nested.has_field(rec, "value").alias("has_value"), nested.is_json_null(value).alias("value_is_null"),
        nested.is_number(value).alias("value_is_number"),
        nested.is_object(nested.field(rec, "parameter")).alias("parameter_is_object"),
        nested.has_field(rec, "parameter.id").alias("has_parameter_id"),
    )


METRICS = """count(*) AS total_records, count(*) FILTER (WHERE valid) AS valid_records, count(*) FILTER (WHERE NOT valid) AS invalid_records,
  count(*) FILTER (WHERE warnings <> '') AS warnings, round(count(*) FILTER (WHERE valid) * 100.0::DOUBLE / count(*) + 1e-9, 6) AS quality_score"""


@query("quality_metrics", "AGG-22 SCL-M7", f"WITH {V} SELECT {METRICS} FROM v")
def quality_metrics(spark, sf_dir):
    return quality.quality_metrics(validated(spark, sf_dir))


@query("quality_by_location", "AGG-22 VAL-10", f"WITH {V} SELECT location_id, {METRICS} FROM v GROUP BY 1")
def quality_by_location(spark, sf_dir):
    return quality.quality_metrics(validated(spark, sf_dir), "location_id")


@query("locations_below_quality_gate", "VAL-10", f"WITH {V} SELECT * FROM (SELECT location_id, {METRICS} FROM v GROUP BY 1) WHERE quality_score < 90")
def locations_below_quality_gate(spark, sf_dir):
    return quality.below_gate(quality.quality_metrics(validated(spark, sf_dir), "location_id"))


@query("first_invalid_records", "LIM-1", f"WITH {V} SELECT seq, errors FROM v WHERE NOT valid ORDER BY seq LIMIT 10")
def first_invalid_records(spark, sf_dir):
    return quality.first_errors(validated(spark, sf_dir))


@query("first_validation_results", "LIM-2", f"WITH {V} SELECT seq, valid, errors, warnings FROM v ORDER BY seq LIMIT 5")
def first_validation_results(spark, sf_dir):
    return quality.first_results(validated(spark, sf_dir))


@query("quality_of_random_sample", "SMP-1 AGG-22", f"""
WITH {V}, s AS (SELECT * FROM v ORDER BY md5('11-' || seq), seq LIMIT 1000) SELECT {METRICS} FROM s""")
def quality_of_random_sample(spark, sf_dir):
    from airloom.operators.sampling import random_sample

    sample = random_sample(damaged_records(spark, sf_dir), 1000, seed=11)
    return quality.quality_metrics(quality.validate(sample, quality.range_rules(spark), AS_OF))


@query("quality_alerts", "ALR-3 VAL-10", f"""
WITH {V}, q AS (SELECT location_id, {METRICS} FROM v GROUP BY 1)
SELECT '{AS_OF}' AS timestamp, 'warning' AS level, 'Low Data Quality: Location ' || location_id AS title,
  'Data quality score: ' || printf('%.2f', quality_score) || '%' AS message,
  '{{"location_id":' || location_id || ',"valid_records":' || valid_records || ',"invalid_records":' || invalid_records || '}}' AS context
FROM q WHERE quality_score < 90""")
def low_quality_alerts(spark, sf_dir):
    return quality_alerts(quality.quality_metrics(validated(spark, sf_dir), "location_id"), AS_OF)


SHORT, THIN = "=" * 60, "-" * 60


@query("validation_report", "VAL-11 SNK-6", f"""
WITH {V}, q AS (SELECT {METRICS} FROM v), e AS (SELECT seq, errors FROM v WHERE NOT valid ORDER BY seq LIMIT 10),
b AS (
 SELECT 1 AS s, '' AS k, ['{SHORT}', 'DATA VALIDATION REPORT', '{SHORT}', 'Timestamp: {AS_OF}', '', 'Total Records: ' || total_records, 'Valid Records: ' || valid_records,
   'Invalid Records: ' || invalid_records, 'Warnings: ' || warnings, 'Quality Score: ' || printf('%.2f', quality_score) || '%', ''] AS lines FROM q
 UNION ALL SELECT 2, '', ['VALIDATION ERRORS:', '{THIN}']
 UNION ALL SELECT 3, lpad(seq::VARCHAR, 20, '0'), list_concat(['Record ' || seq || ':'], ['  - ' || part FOR part IN string_split(errors, ' | ')]) FROM e
 UNION ALL SELECT 4, '', ['']
 UNION ALL SELECT 5, '', ['{SHORT}']),
u AS (SELECT s, k, unnest(lines) AS text, generate_subscripts(lines, 1) AS i FROM b)
SELECT row_number() OVER (ORDER BY s, k, i) AS line_no, text FROM u""")
def validation_report(spark, sf_dir):
    rows = validated(spark, sf_dir)
    return report.validation_report(quality.quality_metrics(rows), quality.first_errors(rows), AS_OF)
