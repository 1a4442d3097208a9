"""Rolling means over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(df: DataFrame, keys: list[str], hours: int = 24, value: str = "value", ts: str = "datetime_utc") -> DataFrame:
    """Mean over the trailing hours, both ends included, per key and time.

    A key's history is cut into chunks as long as the frame. Each reading
    also visits the next chunk, so chunks are independent tasks and a key
    with most of the data still spreads.
    """
    reach = hours * 3_600_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    points = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, ts)
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_at", at)
        .withColumn("_own", F.floor(F.col("_at") / F.lit(reach)))
        .withColumn("_chunk", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_at").rangeBetween(-reach, 0)
    return (
        points.withColumn("_total", F.sum("_sum").over(frame))
        .withColumn("_count", F.sum("_n").over(frame))
        .where(F.col("_chunk") == F.col("_own"))
        .select(*keys, ts, (F.col("_total") / F.col("_count")).alias("rolling_mean"), F.col("_count").alias("readings"))
    )
