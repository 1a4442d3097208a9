"""Row filters of the analysis and the serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom import fixed_values as fixed


def without_locations(df: DataFrame, denied: list[int] | None = None) -> DataFrame:
    return df.where(~F.col("location_id").isin(fixed.DENIED_LOCATIONS if denied is None else denied))


def removal_count(df: DataFrame, denied: list[int] | None = None) -> DataFrame:
    """Rows kept and removed by the deny list, from one pass."""
    hit = F.col("location_id").isin(fixed.DENIED_LOCATIONS if denied is None else denied)
    return df.agg(
        F.count(F.lit(1)).alias("records_before"), F.count_if(~hit).alias("records_after"),
        F.count_if(hit).alias("records_removed"),
    )


def parameter_presence(df: DataFrame, parameters: list[str]) -> DataFrame:
    """Which of the known parameters the data holds."""
    counts = df.groupBy("parameter").agg(F.count(F.lit(1)).alias("_n"))
    known = df.sparkSession.createDataFrame([(p,) for p in parameters], "parameter string")
    return known.join(counts, "parameter", "left").select(
        "parameter", F.coalesce("_n", F.lit(0)).alias("n"), F.col("_n").isNotNull().alias("present")
    )


def _before(as_of: str, days: int):
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def retained(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Records newer than ``days`` before ``as_of``."""
    return df.where(F.col("datetime_utc") > _before(as_of, days))


def recent_of_location(df: DataFrame, location_id: int, as_of: str, days: int = 7) -> DataFrame:
    return retained(df.where(F.col("location_id") == location_id), as_of, days)


def location_parameter_since(df: DataFrame, location_id: int, parameter: str, since: str) -> DataFrame:
    at = F.lit(since).cast("timestamp_ntz")
    return df.where(
        (F.col("location_id") == location_id) & (F.col("parameter") == parameter) & (F.col("datetime_utc") >= at)
    )


def over_threshold(df: DataFrame, parameter: str = "pm25", threshold: float = fixed.PM25_ALERT) -> DataFrame:
    return df.where((F.col("parameter") == parameter) & (F.col("value") > threshold))
