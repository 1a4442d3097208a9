"""Calendar periods whose length follows each parameter's time span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions import calendar
from airloom.operators.joins import null_safe_join
from airloom.session import stage


def every_nth(rank: Column, total: Column, keep: int) -> Column:
    """Every n-th of the ordered categories once there are more than ``keep``.

    ``rank`` counts from 0. n is the whole quotient total / keep, so up to
    2 * keep - 1 categories stay.
    """
    step = F.when(total > keep, F.floor(total / F.lit(keep))).otherwise(F.lit(1))
    return rank % step == 0


def period_calendar(df: DataFrame, keep: int | None = None) -> DataFrame:
    """(parameter, date) to unit and label of its period.

    Built on one row per parameter and day, so the windows see days only.
    """
    days = df.groupBy("parameter", F.to_date("datetime_local").alias("date")).agg(
        F.min("datetime_local").alias("_first"), F.max("datetime_local").alias("_last"),
    )
    whole = Window.partitionBy("parameter")
    span = calendar.elapsed_days(F.min("_first").over(whole), F.max("_last").over(whole))
    units = days.select("parameter", "date", calendar.granularity(span).alias("unit"))
    labelled = units.select("*", calendar.period_label(F.col("date"), F.col("unit")).alias("time_period"))
    if keep is None:
        return labelled
    rank = F.dense_rank().over(whole.orderBy("time_period")) - 1
    ranked = labelled.select("*", rank.alias("_rank"))
    total = ranked.select("*", (F.max("_rank").over(whole) + 1).alias("_total"))
    return total.where(every_nth(F.col("_rank"), F.col("_total"), keep)).drop("_rank", "_total")


def with_periods(df: DataFrame, keep: int | None = None) -> DataFrame:
    """Rows with their period; rows of periods that were not kept drop out."""
    days = stage(period_calendar(df, keep), "period_calendar")
    return null_safe_join(df.withColumn("date", F.to_date("datetime_local")), days, ["parameter", "date"])
