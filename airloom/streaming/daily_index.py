"""The daily air-quality index of a stream of measurements: two stateful aggregates on one watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.operators.aggregates import daily_aqi
from airloom.operators.dedup import not_in
from airloom.operators.pivot import PARAMETERS, aqi_records

DAY = ["location_id", "date"]


def daily_index_stream(
    records: DataFrame, lateness: str = "1 day", parameters: list[str] = PARAMETERS, pollutants: tuple[str, ...] = ("pm25", "o3"),
) -> DataFrame:
    """Mean overall index per location and local day; a day closes ``lateness`` after its end.

    The first aggregate keeps the first value (by ``seq``) of each parameter at a
    place and time until the watermark has passed that hour, when it becomes
    one index; the second one gathers these by day. State is bounded by the
    lateness: open hours of the first, open days of the second. Needs append
    mode. The local wall clock is carried as an instant, for watermarks.
    """
    timed = records.withColumn("event_time", F.col("datetime_local").cast("timestamp")).withWatermark("event_time", lateness)
    hours = aqi_records(timed, parameters, pollutants, (F.window("event_time", "1 hour").alias("hour"),))
    days = hours.groupBy("location_id", F.window(F.window_time("hour"), "1 day").alias("day"))
    return days.agg(F.avg("aqi_overall").alias("aqi"), F.count("aqi_overall").alias("n")).select(
        "location_id", F.to_date("day.start").alias("date"), "aqi", "n"
    )


def open_day_indices(records: DataFrame, closed: DataFrame, parameters: list[str] = PARAMETERS) -> DataFrame:
    """Indices of the days a stream has not closed yet, from the records stored so far (a batch read).

    Days before the last closed one that had no closed row are late data and
    are listed too.
    """
    return not_in(daily_aqi(aqi_records(records, parameters)), closed.select(*DAY), DAY)
