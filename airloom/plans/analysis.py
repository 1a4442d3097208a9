"""The complete analysis of a set of location files: load, then every result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom.functions import calendar
from airloom.operators import aggregates, distribution, filters
from airloom.operators.joins import with_location_name
from airloom.operators.pivot import PARAMETERS, aqi_records
from airloom.plans import charts, report
from airloom.sources import landed
from airloom.sources.store import write_report


def known_names(spark: SparkSession, names: dict[int, str] | None = None) -> DataFrame:
    rows = list((fixed.LOCATION_NAMES if names is None else names).items())
    return spark.createDataFrame(rows, "location_id long, location_name string")


def load(spark: SparkSession, path: str | list[str], names: DataFrame | None = None, denied: list[int] | None = None) -> DataFrame:
    """Flat readings of the location files with name and local time features.

    Denied locations are left out. Unusable documents and records are skipped
    here; ``landed.quarantined_documents`` and ``landed.rejected`` list them.
    """
    documents = landed.parse_documents(landed.read_documents(spark, path))
    rows = landed.with_arrival_order(landed.accepted(landed.typed_records(landed.explode_records(documents))))
    named = with_location_name(filters.without_locations(rows, denied), known_names(spark) if names is None else names)
    local = F.col("datetime_local")
    return named.withColumns({
        "date": F.to_date(local), "hour": F.hour(local), "day_of_week": calendar.day_name(local),
    })


def result_tables(df: DataFrame, names: DataFrame, parameters: list[str] = PARAMETERS) -> dict[str, DataFrame]:
    """Every table of the analysis by name. Nothing runs before one is used."""
    flat = df.drop("location_name", "date", "hour", "day_of_week")
    aqi = aqi_records(flat, parameters)
    return {
        "overview": aggregates.overview(flat),
        "parameter_stats": aggregates.parameter_stats(flat),
        "location_profile": aggregates.location_profile(flat),
        "aqi_overview": aggregates.aqi_overview(aqi),
        "histogram": charts.histogram_with_caption(flat),
        "scatter_points": charts.scatter_points(flat),
        "pair_correlations": aggregates.pair_correlations(flat),
        "series_by_parameter": charts.series_by_parameter(flat, names),
        "series_by_location": charts.series_by_location(flat, names),
        "daily_trend": charts.daily_trend(flat, names),
        "box_plots": distribution.box_summary(flat),
        "box_outliers": distribution.box_outliers(flat),
        "violin_quartiles": distribution.violin_quartiles(flat),
        "violin_density": distribution.violin_density(flat),
        "aqi_series": charts.aqi_series(aqi, names),
        "aqi_bars": charts.aqi_bars(aqi, names),
        "aqi_category_pies": charts.category_pies(aqi),
        "aqi_heatmap": charts.aqi_heatmap(aqi, names),
        "aqi_daily_trend": charts.aqi_daily_trend(aqi, names),
        "aqi_hour_profile": charts.aqi_hour_profile(aqi, names),
        "aqi_period_trend": charts.aqi_period_trend(aqi, names),
        "parameter_heatmap": charts.parameter_heatmap(flat, names, parameters),
    }


def write_analysis(df: DataFrame, names: DataFrame, output: str, generated: str, parameters: list[str] = PARAMETERS) -> list[str]:
    """Write every table as Parquet and the summary as text; returns what was written.

    Each table is its own job, so ``df`` should be a stored table, not raw JSON.
    """
    tables = result_tables(df, names, parameters)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{output}/{name}")
    flat = df.drop("location_name", "date", "hour", "day_of_week")
    write_report(report.summary_report(flat, names, generated, output), f"{output}/summary_statistics")
    return [*tables, "summary_statistics"]
