"""The rows behind each chart of the analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom.functions import reference_levels
from airloom.functions.aqi import aqi_category, aqi_color
from airloom.operators import aggregates
from airloom.operators.distribution import histogram
from airloom.operators.joins import null_safe_join, with_location_name
from airloom.operators.periods import every_nth
from airloom.operators.pivot import pivot_mean

SERIES = ["parameter", "location_id", "datetime_local", "seq"]


def histogram_with_caption(df: DataFrame) -> DataFrame:
    """Bins of every parameter with count, mean, median and deviation beside them."""
    caption = aggregates.parameter_stats(df).select("parameter", F.col("n").alias("records"), "mean", "std", "median")
    return null_safe_join(histogram(df, ["parameter"]), caption, ["parameter"])


def scatter_points(df: DataFrame, pairs=tuple(fixed.SCATTER_PAIRS)) -> DataFrame:
    """Points of each parameter pair where both are present."""
    names = sorted({p for pair in pairs for p in pair})
    wide = pivot_mean(df.where(F.col("parameter").isin(names)), names, ["location_id", "datetime_utc"])
    pair_rows = F.array(*[
        F.struct(F.lit(a).alias("parameter_x"), F.lit(b).alias("parameter_y"),
                 F.col(a).alias("x"), F.col(b).alias("y"))
        for a, b in pairs
    ])
    return wide.select("location_id", "datetime_utc", F.inline(pair_rows)).dropna(subset=["x", "y"])


def series_by_parameter(df: DataFrame, names: DataFrame) -> DataFrame:
    """Every reading in series order with location name and guideline."""
    return (
        with_location_name(df, names)
        .withColumn("guideline", reference_levels.who_guideline(F.col("parameter")))
        .withColumn("exceeds", reference_levels.exceeds_guideline(F.col("parameter"), F.col("value")))
        .orderBy(*SERIES)
        .select("parameter", "location_id", "location_name", "datetime_local", "seq", "value", "units", "guideline", "exceeds")
    )


def series_by_location(df: DataFrame, names: DataFrame) -> DataFrame:
    ordered = ["location_id", "parameter", "datetime_local", "seq"]
    return (
        with_location_name(df, names).withColumn("panel", F.upper("parameter"))
        .orderBy(*ordered).select("location_name", "panel", *ordered, "value", "units")
    )


def daily_trend(df: DataFrame, names: DataFrame) -> DataFrame:
    return with_location_name(aggregates.daily_means(df), names).orderBy("parameter", "location_id", "date")


def aqi_series(records: DataFrame, names: DataFrame) -> DataFrame:
    return (
        with_location_name(records, names)
        .withColumn("band_top", reference_levels.aqi_band_top(F.col("aqi_overall")))
        .orderBy("location_id", "datetime_local")
        .select("location_id", "location_name", "datetime_local", "aqi_overall", "aqi_category", "band_top")
    )


def aqi_bars(records: DataFrame, names: DataFrame) -> DataFrame:
    return with_location_name(aggregates.aqi_by_location(records), names).orderBy("location_id")


def category_pies(records: DataFrame) -> DataFrame:
    """Shares on record level and on daily level in one table."""
    both = [
        aggregates.category_share(records).withColumn("level", F.lit("record")),
        aggregates.daily_category_share(records).withColumn("level", F.lit("day")),
    ]
    # a category's own colour does not depend on the mean that led to it
    by_name = {name: color for _, name, color in fixed.AQI_CATEGORIES}
    by_name |= dict([fixed.HAZARDOUS, fixed.UNKNOWN])
    color = F.lit(None).cast("string")
    for name, shade in by_name.items():
        color = F.when(F.col("aqi_category") == name, shade).otherwise(color)
    return both[0].unionByName(both[1]).withColumn("color", color)


def aqi_heatmap(records: DataFrame, names: DataFrame, keep: int | None = None) -> DataFrame:
    """Mean AQI per location and local date; ``keep`` thins the dates for a drawing."""
    cells = aggregates.daily_aqi(records).where("aqi IS NOT NULL")
    if keep is None:
        return with_location_name(cells, names)
    # one row per day of the whole range
    ordered = Window.orderBy("date")
    dates = (
        cells.select("date").distinct().withColumn("_rank", F.row_number().over(ordered) - 1)
        .withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy()))
        .where(every_nth(F.col("_rank"), F.col("_total"), keep))
        .select("date")
    )
    return with_location_name(cells.join(dates, "date", "left_semi"), names)


def aqi_daily_trend(records: DataFrame, names: DataFrame) -> DataFrame:
    trend = aggregates.daily_aqi(records)
    return (
        with_location_name(trend, names).withColumn("category", aqi_category(F.col("aqi")))
        .withColumn("band_color", aqi_color(F.col("aqi"))).orderBy("location_id", "date")
    )


def aqi_hour_profile(records: DataFrame, names: DataFrame) -> DataFrame:
    return with_location_name(aggregates.hourly_aqi(records), names).orderBy("location_id", "hour")


def aqi_period_trend(records: DataFrame, names: DataFrame, ticks: int = fixed.AXIS_TICKS) -> DataFrame:
    """15-day means with the place of each period on the axis and its tick."""
    order = aggregates.period_order(records)
    step = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / F.lit(ticks)), F.lit(1))
    order = order.withColumn("is_tick", F.col("period_order") % step == 0).select(
        "period_num", "period_order", "is_tick"
    )
    trend = aggregates.period_aqi(records).join(order, "period_num")
    return with_location_name(trend, names).orderBy("location_id", "period_order")


def parameter_heatmap(df: DataFrame, names: DataFrame, parameters: list[str]) -> DataFrame:
    """Mean matrix by location name; names shared by two locations fall together.

    Names meet the sums of each location, not its readings.
    """
    sums = with_location_name(aggregates.location_parameter_rollup(df), names)

    def total(parameter: str, column: str):
        return F.sum(F.when(F.col("parameter") == parameter, F.col(column)))

    cells = [F.try_divide(total(p, "total"), total(p, "n_values")).alias(p) for p in parameters]
    return sums.groupBy("location_name").agg(*cells)


def pm25_line(df: DataFrame, location_id: int, as_of: str, days: int = 7) -> DataFrame:
    """Recent PM2.5 of one location in time order."""
    after = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return (
        df.where((F.col("location_id") == location_id) & (F.col("parameter") == "pm25") & (F.col("datetime_utc") > after))
        .orderBy("datetime_local", "seq").select("datetime_local", "seq", "value")
    )
