"""Group-by statistics over flat measurements and AQI records.

Questions about locations and parameters share one small rollup, so the large
table is read once per question and only partial sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom.functions import aqi, calendar
from airloom.functions.text import sorted_names
from airloom.operators.joins import null_safe_join
from airloom.operators.pivot import pivot_mean
from airloom.operators.quantiles import exact_median

def _n() -> Column:
    return F.count(F.lit(1))


def location_parameter_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy("location_id", "parameter").agg(
        _n().alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"),
        F.max("value").alias("max_value"),
        F.min("datetime_local").alias("first_local"), F.max("datetime_local").alias("last_local"),
    )


def overview(df: DataFrame) -> DataFrame:
    """Rows, locations, parameters and local time range of the whole set."""
    return location_parameter_rollup(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.countDistinct("location_id").alias("locations"),
        F.countDistinct("parameter").alias("n_parameters"),
        sorted_names(F.collect_set("parameter")).alias("parameters"),
        F.min("first_local").alias("first_local"), F.max("last_local").alias("last_local"),
    )


def parameter_stats(df: DataFrame) -> DataFrame:
    """Count, mean, median, extremes and sample deviation; units as first seen."""
    # per unit first: a text inside the aggregate would make Spark sort all rows
    by_unit = df.groupBy("parameter", "units").agg(
        _n().alias("_n"), F.count("value").alias("_values"), F.avg("value").alias("_mean"),
        F.var_pop("value").alias("_var"), F.min("value").alias("_min"), F.max("value").alias("_max"),
        F.min("seq").alias("_first"),
    )
    whole = Window.partitionBy("parameter")
    weighted = F.sum(F.col("_mean") * F.col("_values")).over(whole) / F.nullif(F.sum("_values").over(whole), F.lit(0))
    spread = F.expr("sum(_values * (_var + (_mean - mean) * (_mean - mean)))")
    stats = by_unit.withColumn("mean", weighted).groupBy("parameter", "mean").agg(
        F.min_by("units", F.when(F.col("units").isNotNull(), F.col("_first"))).alias("units"),
        F.sum("_n").alias("n"), F.min("_min").alias("min"), F.max("_max").alias("max"),
        F.when(F.sum("_values") > 1, F.sqrt(spread / (F.sum("_values") - 1))).alias("std"),
    )
    return null_safe_join(stats, exact_median(df, ["parameter"], "value"), ["parameter"], "left")


def location_profile(df: DataFrame) -> DataFrame:
    """Records, parameters, time range and PM2.5 mean and maximum of each location."""
    pm25 = F.col("parameter") == "pm25"
    return location_parameter_rollup(df).groupBy("location_id").agg(
        F.sum("n").alias("records"),
        sorted_names(F.collect_set("parameter")).alias("parameters"),
        F.min("first_local").alias("first_local"), F.max("last_local").alias("last_local"),
        F.try_divide(F.sum(F.when(pm25, F.col("total"))), F.sum(F.when(pm25, F.col("n_values")))).alias("pm25_mean"),
        F.max(F.when(pm25, F.col("max_value"))).alias("pm25_max"),
    )


def distinct_parameters(df: DataFrame) -> DataFrame:
    return df.groupBy("parameter").agg(_n().alias("n")).select("parameter")


def records_per_location(df: DataFrame) -> DataFrame:
    return df.groupBy("location_id").agg(_n().alias("n"))


def daily_means(df: DataFrame) -> DataFrame:
    """Mean per parameter, location and local date."""
    return df.groupBy("parameter", "location_id", F.to_date("datetime_local").alias("date")).agg(
        F.avg("value").alias("mean")
    )


def daily_pm25_utc(df: DataFrame) -> DataFrame:
    return (
        df.where("parameter = 'pm25'")
        .groupBy(F.to_date("datetime_utc").alias("date"))
        .agg(F.avg("value").alias("mean"))
    )


def location_parameter_means(df: DataFrame, parameters: list[str], by: str = "location_id") -> DataFrame:
    """Mean matrix, a row per location and a column per parameter."""
    return pivot_mean(df, parameters, [by])


def hotspots(df: DataFrame, n: int = fixed.HOTSPOTS) -> DataFrame:
    """Locations with the highest PM2.5 mean; 0 for those that have none."""
    mean = F.coalesce(F.avg(F.when(F.col("parameter") == "pm25", F.col("value"))), F.lit(0.0))
    return (
        df.groupBy("location_id").agg(mean.alias("pm25_mean"))
        .orderBy(F.desc("pm25_mean"), "location_id").limit(n)
    )


def pair_correlations(df: DataFrame, pairs=tuple(fixed.SCATTER_PAIRS)) -> DataFrame:
    """Pearson r and sample count of each pair, aligned by location and time.

    A pair without rows in common is left out; one without spread has NULL r.
    """
    names = sorted({p for pair in pairs for p in pair})
    wide = pivot_mean(df.where(F.col("parameter").isin(names)), names, ["location_id", "datetime_utc"])
    cells = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        cells += [F.nanvl(F.corr(a, b), F.lit(None).cast("double")).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    per_pair = F.array(*[
        F.struct(F.lit(a).alias("parameter_x"), F.lit(b).alias("parameter_y"),
                 F.col(f"r{i}").alias("correlation"), F.col(f"n{i}").alias("samples"))
        for i, (a, b) in enumerate(pairs)
    ])
    return wide.agg(*cells).select(F.inline(per_pair)).where("samples > 0")


def _share(n: str = "n") -> Column:
    return F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy())


def category_share(records: DataFrame, category: str = "aqi_category") -> DataFrame:
    """Count and percentage per category, most frequent first."""
    counts = records.groupBy(category).agg(_n().alias("n"))
    return counts.withColumn("share", _share()).orderBy(F.desc("n"), category)


def aqi_overview(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("aqi_overall").alias("n"), F.avg("aqi_overall").alias("mean_aqi"), F.max("aqi_overall").alias("max_aqi")
    )


def aqi_by_location(records: DataFrame) -> DataFrame:
    """Mean AQI of each location with the category and colour of that mean."""
    means = records.groupBy("location_id").agg(F.avg("aqi_overall").alias("mean_aqi"))
    return means.withColumn("category", aqi.aqi_category(F.col("mean_aqi"))).withColumn(
        "color", aqi.aqi_color(F.col("mean_aqi"))
    )


def daily_aqi(records: DataFrame) -> DataFrame:
    return records.groupBy("location_id", F.to_date("datetime_local").alias("date")).agg(
        F.avg("aqi_overall").alias("aqi")
    )


def daily_category_share(records: DataFrame) -> DataFrame:
    """Categories of the daily mean over all locations, counted over days."""
    days = records.groupBy(F.to_date("datetime_local").alias("date")).agg(F.avg("aqi_overall").alias("aqi"))
    return category_share(days.withColumn("aqi_category", aqi.aqi_category(F.col("aqi"))))


def hourly_aqi(records: DataFrame) -> DataFrame:
    return records.groupBy("location_id", F.hour("datetime_local").alias("hour")).agg(
        F.avg("aqi_overall").alias("aqi")
    )


def period_aqi(records: DataFrame, days: int = fixed.PERIOD_DAYS) -> DataFrame:
    """Mean AQI per location and 15-day period counted from the first date.

    Daily sums come first; the first date is a scalar subquery over their dates.
    """
    daily = records.groupBy("location_id", F.to_date("datetime_local").alias("date")).agg(
        F.sum("aqi_overall").alias("_sum"), F.count("aqi_overall").alias("_n")
    )
    dated = daily.withColumn("_first_date", daily.agg(F.min("date")).scalar())
    numbered = dated.withColumn("period_num", calendar.bucket_number(F.col("date"), F.col("_first_date"), days))
    return (
        numbered.groupBy("location_id", "period_num", "_first_date")
        .agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("aqi"))
        .withColumn("period", calendar.bucket_label(F.col("_first_date"), F.col("period_num"), days))
        .select("location_id", "period_num", "period", "aqi")
    )


def period_order(records: DataFrame, days: int = fixed.PERIOD_DAYS) -> DataFrame:
    """Periods that occur, their earliest date and their place in time order."""
    dates = records.groupBy(F.to_date("datetime_local").alias("date")).agg(_n().alias("_n"))
    periods = (
        dates.withColumn("_first_date", dates.agg(F.min("date")).scalar())
        .withColumn("period_num", calendar.bucket_number(F.col("date"), F.col("_first_date"), days))
        .groupBy("period_num", "_first_date").agg(F.min("date").alias("earliest"))
    )
    # one row per period of the whole range
    place = F.row_number().over(Window.orderBy("period_num")) - 1
    return periods.select(
        "period_num", calendar.bucket_label(F.col("_first_date"), F.col("period_num"), days).alias("period"),
        "earliest", place.alias("period_order"),
    )


def time_spans(df: DataFrame) -> DataFrame:
    """Whole days between first and last reading per parameter, and the unit they call for."""
    span = calendar.elapsed_days(F.min("datetime_local"), F.max("datetime_local"))
    spans = df.groupBy("parameter").agg(span.alias("span_days"))
    return spans.withColumn("unit", calendar.granularity(F.col("span_days")))


def high_watermarks(df: DataFrame, keys: tuple[str, ...] = ("location_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("datetime_to_utc").alias("last_fetch_time"))


def first_and_last(df: DataFrame) -> DataFrame:
    """Local time of the earliest and the latest record of each location, by UTC.

    Readings of one place and instant share their local time, so ties do not matter.
    """
    return df.groupBy("location_id").agg(
        F.min_by("datetime_local", "datetime_utc").alias("first_local"),
        F.max_by("datetime_local", "datetime_utc").alias("last_local"),
    )


def error_rate(df: DataFrame, failed: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        _n().alias("total"), F.count_if(failed).alias("errors"),
        F.try_divide(F.count_if(failed), _n()).alias("error_rate"),
    )
