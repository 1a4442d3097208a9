"""Text reports as (line_no, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.text import decimals, thousands
from airloom.operators import aggregates
from airloom.operators.joins import with_location_name

RULE = "=" * 80
THIN_RULE = "-" * 80
SHORT_RULE = "=" * 60
SHORT_THIN_RULE = "-" * 60


def _section(df: DataFrame, place: int, key: Column, *lines: Column) -> DataFrame:
    """Lines of each row under a sort key; NULL lines are left out."""
    texts = F.array_compact(F.array(*lines))
    return df.select(
        F.lit(place).alias("_place"), key.cast("string").alias("_key"), F.posexplode(texts).alias("_pos", "text")
    )


def _fixed_lines(spark, place: int, *lines: str) -> DataFrame:
    return _section(spark.range(1), place, F.lit(""), *[F.lit(t) for t in lines])


def _numbered(*sections: DataFrame) -> DataFrame:
    rows = sections[0]
    for section in sections[1:]:
        rows = rows.unionByName(section)
    # some lines per parameter and location
    order = Window.orderBy("_place", "_key", "_pos")
    return rows.select(F.row_number().over(order).cast("long").alias("line_no"), "text")


def summary_report(df: DataFrame, names: DataFrame, generated: str, output: str) -> DataFrame:
    """The summary of the whole set: totals, parameters, locations."""
    spark = df.sparkSession
    rollup = aggregates.overview(df)
    text = F.concat
    head = _section(
        rollup, 1, F.lit(""),
        F.lit(RULE), F.lit("AIR QUALITY DATA ANALYTICS SUMMARY"), F.lit(RULE), F.lit(""),
        F.lit(f"Generated: {generated}"),
        text(F.lit("Total Records: "), thousands(F.col("records"))),
        text(F.lit("Date Range: "), F.col("first_local").cast("string"), F.lit(" to "), F.col("last_local").cast("string")),
        F.lit(f"Output Directory: {output}"), F.lit(""), F.lit(RULE), F.lit(""),
    )
    parameters = _section(
        aggregates.parameter_stats(df), 3, F.col("parameter"),
        F.lit(""), text(F.upper("parameter"), F.lit(" ("), F.coalesce("units", F.lit("")), F.lit("):")),
        text(F.lit("  Count:   "), thousands(F.col("n"))),
        *[
            text(F.lit(label), decimals(F.col(c), 2))
            for label, c in (
                ("  Mean:    ", "mean"), ("  Median:  ", "median"), ("  Min:     ", "min"),
                ("  Max:     ", "max"), ("  Std Dev: ", "std"),
            )
        ],
    )
    named = with_location_name(aggregates.location_profile(df), names)
    # zero-padded, so that text order is id order
    locations = _section(
        named, 5, F.lpad(F.col("location_id").cast("string"), 20, "0"),
        F.lit(""), text(F.col("location_name"), F.lit(" (ID: "), F.col("location_id").cast("string"), F.lit("):")),
        text(F.lit("  Total Records: "), thousands(F.col("records"))),
        text(F.lit("  Parameters: "), F.col("parameters")),
        text(F.lit("  Date Range: "), F.col("first_local").cast("string"), F.lit(" to "), F.col("last_local").cast("string")),
        text(F.lit("  PM2.5 Mean: "), decimals(F.col("pm25_mean"), 2), F.lit(" µg/m³")),
        text(F.lit("  PM2.5 Max:  "), decimals(F.col("pm25_max"), 2), F.lit(" µg/m³")),
    )
    return _numbered(
        head,
        _fixed_lines(spark, 2, "PARAMETER STATISTICS", THIN_RULE),
        parameters,
        _fixed_lines(spark, 4, "", RULE, "", "LOCATION STATISTICS", THIN_RULE),
        locations,
        _fixed_lines(spark, 6, "", RULE, ""),
    )


def validation_report(metrics: DataFrame, errors: DataFrame, generated: str, order: str = "seq") -> DataFrame:
    """Counters and the first invalid records with their errors."""
    spark = metrics.sparkSession
    counters = (
        ("Total Records: ", "total_records"), ("Valid Records: ", "valid_records"),
        ("Invalid Records: ", "invalid_records"), ("Warnings: ", "warnings"),
    )
    head = _section(
        metrics, 1, F.lit(""),
        F.lit(SHORT_RULE), F.lit("DATA VALIDATION REPORT"), F.lit(SHORT_RULE), F.lit(f"Timestamp: {generated}"), F.lit(""),
        *[F.concat(F.lit(label), F.col(c).cast("string")) for label, c in counters],
        F.concat(F.lit("Quality Score: "), decimals(F.coalesce("quality_score", F.lit(0.0)), 2), F.lit("%")), F.lit(""),
    )
    some = errors.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    title = _section(some, 2, F.lit(""), F.lit("VALIDATION ERRORS:"), F.lit(SHORT_THIN_RULE))
    lines = F.concat(
        F.array(F.concat(F.lit("Record "), F.col(order).cast("string"), F.lit(":"))),
        F.transform("errors", lambda e: F.concat(F.lit("  - "), e)),
    )
    details = errors.select(
        F.lit(3).alias("_place"), F.lpad(F.col(order).cast("string"), 38, "0").alias("_key"),
        F.posexplode(lines).alias("_pos", "text"),
    )
    gap = _section(some, 4, F.lit(""), F.lit(""))
    return _numbered(head, title, details, gap, _fixed_lines(spark, 5, SHORT_RULE))
