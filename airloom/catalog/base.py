"""Registry of queries and the stand-in views they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.operators.pivot import aqi_records
from airloom.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name; ``covers`` lists inventory rows."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(configure(spark), sf_dir))

        CATALOG[name] = Query(name, covers, run, sql)
        return run

    return add


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Portable result types: rounded doubles, text for times, bigint counts, joined lists.

    A hair is added before rounding, so that an exact half rounds the same way
    whatever order its sum was built in.
    """
    shown = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c + 1e-9, digits)
        elif isinstance(t, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c, " | ")
        shown.append(c.alias(field.name))
    return df.select(*shown)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- stand-in views ---------------------------------------------------------

PARAMETERS = ["pm1", "pm25", "o3", "temperature", "relativehumidity"]


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as hourly sensor readings, five parameters at ten places."""
    kind = F.col("event_type")
    parameter = (
        F.when(kind == "view", "pm25").when(kind == "click", "pm1").when(kind == "error", "o3")
        .when(kind == "signup", "temperature").otherwise("relativehumidity")
    )
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    p = F.col("parameter")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 10 + 1).alias("location_id"),
        parameter.alias("parameter"),
        F.when(kind == "error", F.col("value") / 1000).otherwise(F.col("value")).alias("value"),
        hour.alias("datetime_utc"),
        (hour + F.expr("INTERVAL 345 MINUTES")).alias("datetime_local"),
        (hour + F.expr("INTERVAL 1 HOUR")).alias("datetime_to_utc"),
        F.col("user_id").alias("sensor_id"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    ).withColumns({
        "units": F.when(p == "o3", "ppm").when(p == "temperature", "c").when(p == "relativehumidity", "%").otherwise("µg/m³"),
        "parameter_id": F.when(p == "pm1", 1).when(p == "pm25", 2).when(p == "o3", 3).when(p == "temperature", 4).otherwise(5).cast("long"),
    })


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as readings over several years, one parameter per priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 10 + 1).alias("location_id"),
        F.col("o_orderpriority").alias("parameter"), F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("datetime_utc"), F.col("o_orderdate").alias("datetime_local"),
    )


def line_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as readings, one parameter per return flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("location_id"), F.col("l_returnflag").alias("parameter"),
        F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("datetime_utc"),
        F.col("l_shipdate").alias("datetime_local"), "l_orderkey", "l_linenumber", "l_partkey",
    )


def location_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for the places that share a region's number; the others have none."""
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("location_id"), F.col("r_name").alias("location_name")
    )


def aqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aqi_records(measurements(spark, sf_dir), PARAMETERS)


# --- the same views in SQL ---------------------------------------------------

M = """m AS (
  SELECT event_id AS seq, user_id % 10 + 1 AS location_id,
    CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm1' WHEN 'error' THEN 'o3'
      WHEN 'signup' THEN 'temperature' ELSE 'relativehumidity' END AS parameter,
    CASE event_type WHEN 'error' THEN value / 1000 ELSE value END AS value,
    CASE event_type WHEN 'error' THEN 'ppm' WHEN 'signup' THEN 'c' WHEN 'view' THEN 'µg/m³'
      WHEN 'click' THEN 'µg/m³' ELSE '%' END AS units,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END::BIGINT AS parameter_id,
    user_id AS sensor_id,
    date_trunc('hour', ts) AS datetime_utc,
    date_trunc('hour', ts) + INTERVAL 345 MINUTE AS datetime_local,
    date_trunc('hour', ts) + INTERVAL 1 HOUR AS datetime_to_utc,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

OM = """om AS (
  SELECT o_orderkey AS seq, o_custkey % 10 + 1 AS location_id, o_orderpriority AS parameter,
    o_totalprice AS value, o_orderdate AS datetime_utc, o_orderdate AS datetime_local
  FROM orders)"""

LM = """lm AS (
  SELECT l_suppkey AS location_id, l_returnflag AS parameter, l_extendedprice AS value,
    l_shipdate AS datetime_utc, l_shipdate AS datetime_local, l_orderkey, l_linenumber, l_partkey
  FROM lineitem)"""

NAMES = "nm AS (SELECT r_regionkey::BIGINT AS location_id, r_name AS location_name FROM region)"


def name_sql(alias: str) -> str:
    return f"coalesce(nm.location_name, 'Location ' || {alias}.location_id)"


def pm25_sql(c: str) -> str:
    return f"""CAST(CASE
      WHEN {c} >= 0.0::DOUBLE AND {c} <= 12.0::DOUBLE THEN round_even((50 - 0) / (12.0::DOUBLE - 0.0::DOUBLE) * ({c} - 0.0::DOUBLE) + 0, 0)
      WHEN {c} >= 12.1::DOUBLE AND {c} <= 35.4::DOUBLE THEN round_even((100 - 51) / (35.4::DOUBLE - 12.1::DOUBLE) * ({c} - 12.1::DOUBLE) + 51, 0)
      WHEN {c} >= 35.5::DOUBLE AND {c} <= 55.4::DOUBLE THEN round_even((150 - 101) / (55.4::DOUBLE - 35.5::DOUBLE) * ({c} - 35.5::DOUBLE) + 101, 0)
      WHEN {c} >= 55.5::DOUBLE AND {c} <= 150.4::DOUBLE THEN round_even((200 - 151) / (150.4::DOUBLE - 55.5::DOUBLE) * ({c} - 55.5::DOUBLE) + 151, 0)
      WHEN {c} >= 150.5::DOUBLE AND {c} <= 250.4::DOUBLE THEN round_even((300 - 201) / (250.4::DOUBLE - 150.5::DOUBLE) * ({c} - 150.5::DOUBLE) + 201, 0)
      WHEN {c} >= 250.5::DOUBLE AND {c} <= 500.4::DOUBLE THEN round_even((500 - 301) / (500.4::DOUBLE - 250.5::DOUBLE) * ({c} - 250.5::DOUBLE) + 301, 0)
      WHEN {c} > 500.4::DOUBLE THEN 500 END AS BIGINT)"""


def pm10_sql(c: str) -> str:
    return f"""CAST(CASE
      WHEN {c} >= 0 AND {c} <= 54 THEN round_even(50 / 54.0::DOUBLE * {c}, 0)
      WHEN {c} >= 55 AND {c} <= 154 THEN round_even(49 / 99.0::DOUBLE * ({c} - 55) + 51, 0)
      WHEN {c} >= 155 AND {c} <= 254 THEN round_even(49 / 99.0::DOUBLE * ({c} - 155) + 101, 0)
      WHEN {c} >= 255 AND {c} <= 354 THEN round_even(49 / 99.0::DOUBLE * ({c} - 255) + 151, 0)
      WHEN {c} >= 355 AND {c} <= 424 THEN round_even(99 / 69.0::DOUBLE * ({c} - 355) + 201, 0)
      WHEN {c} >= 425 AND {c} <= 604 THEN round_even(199 / 179.0::DOUBLE * ({c} - 425) + 301, 0)
      WHEN {c} > 604 THEN 500 END AS BIGINT)"""


def o3_sql(c: str) -> str:
    return f"""CAST(CASE
      WHEN {c} >= 0.000::DOUBLE AND {c} <= 0.054::DOUBLE THEN round_even(50 / (0.054::DOUBLE - 0.000::DOUBLE) * ({c} - 0.000::DOUBLE) + 0, 0)
      WHEN {c} >= 0.055::DOUBLE AND {c} <= 0.070::DOUBLE THEN round_even(49 / (0.070::DOUBLE - 0.055::DOUBLE) * ({c} - 0.055::DOUBLE) + 51, 0)
      WHEN {c} >= 0.071::DOUBLE AND {c} <= 0.085::DOUBLE THEN round_even(49 / (0.085::DOUBLE - 0.071::DOUBLE) * ({c} - 0.071::DOUBLE) + 101, 0)
      WHEN {c} >= 0.086::DOUBLE AND {c} <= 0.105::DOUBLE THEN round_even(49 / (0.105::DOUBLE - 0.086::DOUBLE) * ({c} - 0.086::DOUBLE) + 151, 0)
      WHEN {c} >= 0.106::DOUBLE AND {c} <= 0.200::DOUBLE THEN round_even(99 / (0.200::DOUBLE - 0.106::DOUBLE) * ({c} - 0.106::DOUBLE) + 201, 0)
      WHEN {c} > 0.200::DOUBLE THEN 300 END AS BIGINT)"""


def category_sql(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Moderate'
      WHEN {x} <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN {x} <= 200 THEN 'Unhealthy'
      WHEN {x} <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"""


def color_sql(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'gray' WHEN {x} <= 50 THEN 'green' WHEN {x} <= 100 THEN 'yellow'
      WHEN {x} <= 150 THEN 'orange' WHEN {x} <= 200 THEN 'red' WHEN {x} <= 300 THEN 'purple' ELSE 'maroon' END"""


P = """p AS (
  SELECT location_id, datetime_utc, datetime_local,
    arg_min(value, seq) FILTER (WHERE parameter = 'pm1') AS pm1,
    arg_min(value, seq) FILTER (WHERE parameter = 'pm25') AS pm25,
    arg_min(value, seq) FILTER (WHERE parameter = 'o3') AS o3,
    arg_min(value, seq) FILTER (WHERE parameter = 'temperature') AS temperature,
    arg_min(value, seq) FILTER (WHERE parameter = 'relativehumidity') AS relativehumidity
  FROM m WHERE value IS NOT NULL GROUP BY location_id, datetime_utc, datetime_local)"""

A = f"""{M}, {P},
i AS (SELECT *, {pm25_sql('pm25')} AS aqi_pm25, {o3_sql('o3')} AS aqi_o3 FROM p),
o AS (SELECT *, greatest(aqi_pm25, aqi_o3) AS aqi_overall FROM i),
a AS (SELECT *, {category_sql('aqi_overall')} AS aqi_category, {color_sql('aqi_overall')} AS aqi_color FROM o)"""
