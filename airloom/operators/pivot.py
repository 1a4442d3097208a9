"""One row per place and time with a column per parameter, and the AQI on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions import aqi

PARAMETERS = ["pm1", "pm10", "pm25", "o3", "relativehumidity", "temperature", "um003"]
PLACE_AND_TIME = ["location_id", "datetime_utc", "datetime_local"]


def pivot_first(df: DataFrame, parameters: list[str], keys: list[str] = PLACE_AND_TIME, order: str = "seq") -> DataFrame:
    """First non-null value by ``order``; conditional aggregates, one shuffle."""
    cells = [
        F.min_by("value", F.when(F.col("parameter") == p, F.col(order))).alias(p) for p in parameters
    ]
    return df.where(F.col("value").isNotNull()).groupBy(*keys).agg(*cells)


def pivot_mean(df: DataFrame, parameters: list[str], keys: list[str]) -> DataFrame:
    cells = [F.avg(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in parameters]
    return df.where(F.col("value").isNotNull()).groupBy(*keys).agg(*cells)


def aqi_records(
    df: DataFrame,
    parameters: list[str] = PARAMETERS,
    pollutants: tuple[str, ...] = ("pm25", "o3"),
    more_keys: tuple[Column, ...] = (),
) -> DataFrame:
    """Wide table with an index per pollutant, their maximum and its category.

    The ozone index counts only readings given in ppm. ``more_keys`` group
    beside place and time (the window of a stream).
    """
    usable = df.where(F.col("value").isNotNull())
    cells = [F.min_by("value", F.when(F.col("parameter") == p, F.col("seq"))).alias(p) for p in parameters]
    ppm = (F.col("parameter") == "o3") & (F.col("units") == "ppm")
    wide = usable.groupBy(*PLACE_AND_TIME, *more_keys).agg(
        *cells, F.min_by("value", F.when(ppm, F.col("seq"))).alias("_o3_ppm")
    )
    by_pollutant = {
        "pm25": lambda: aqi.aqi_pm25(F.col("pm25")),
        "pm10": lambda: aqi.aqi_pm10(F.col("pm10")),
        "o3": lambda: aqi.aqi_o3(F.col("_o3_ppm")),
    }
    wide = wide.withColumns({f"aqi_{p}": by_pollutant[p]() for p in pollutants})
    overall = aqi.overall_aqi(*[F.col(f"aqi_{p}") for p in pollutants])
    return (
        wide.drop("_o3_ppm")
        .withColumn("aqi_overall", overall)
        .withColumn("aqi_category", aqi.aqi_category(F.col("aqi_overall")))
        .withColumn("aqi_color", aqi.aqi_color(F.col("aqi_overall")))
    )
