"""Tumbling daily means over a stream of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from airloom.operators.dedup import not_in


def daily_means_stream(records: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Mean per parameter, location and local day; days close ``lateness`` later.

    Event time has to be an instant for watermarks, so the local wall clock is
    carried as one.
    """
    timed = records.withColumn("event_time", F.col("datetime_local").cast("timestamp"))
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy("parameter", "location_id", F.window("event_time", "1 day").alias("day"))
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
        .select("parameter", "location_id", F.to_date("day.start").alias("date"), "mean", "n")
    )


def open_days(records: DataFrame, closed: DataFrame) -> DataFrame:
    """Means of the days a stream has not closed yet, from the records landed so far (a batch read)."""
    days = records.groupBy("parameter", "location_id", F.to_date("datetime_local").alias("date")).agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")
    )
    return not_in(days, closed, ["parameter", "location_id", "date"])


def write_closed_days(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each day once, when the watermark has passed it."""
    return (
        days.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
