"""Time columns: parsing, local-time features, period labels, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airloom import fixed_values as fixed

# ISO 8601 date, or date and time with optional fraction and offset.
ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)

WITH_OFFSET = r"[T ]\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$"


def parse_utc(text: Column) -> Column:
    """ISO text to the UTC wall clock, in any session zone; NULL when it does not parse. Without offset it is UTC."""
    moment = text.try_cast("timestamp").cast("timestamp_ntz")
    in_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment)
    return F.when(text.rlike(WITH_OFFSET), in_utc).otherwise(text.try_cast("timestamp_ntz"))


def parse_local(text: Column) -> Column:
    """ISO text to the wall clock it shows, whatever its offset."""
    return text.try_cast("timestamp_ntz")


def utc_offset(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1), F.lit(""))


def is_iso(text: Column) -> Column:
    return text.rlike(ISO_PATTERN) & text.try_cast("timestamp").isNotNull()


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_label(ts: Column) -> Column:
    """Monday/Sunday of the week, as ``start/end``."""
    monday = F.to_date(F.date_trunc("week", ts))
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def day_label(ts: Column) -> Column:
    return F.to_date(ts).cast("string")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days passed, rounded down."""
    return F.timestamp_diff("DAY", start, end)


def granularity(span_days: Column) -> Column:
    return (
        F.when(span_days > fixed.MONTH_ABOVE_DAYS, F.lit("Month"))
        .when(span_days > fixed.WEEK_ABOVE_DAYS, F.lit("Week"))
        .otherwise(F.lit("Day"))
    )


def period_label(ts: Column, unit: Column) -> Column:
    return (
        F.when(unit == "Month", month_label(ts))
        .when(unit == "Week", week_label(ts))
        .otherwise(day_label(ts))
    )


def bucket_number(date: Column, first_date: Column, days: int = fixed.PERIOD_DAYS) -> Column:
    return F.floor(F.datediff(date, first_date) / F.lit(days)).cast("long")


def bucket_label(first_date: Column, number: Column, days: int = fixed.PERIOD_DAYS) -> Column:
    start = F.date_add(first_date, (number * days).cast("int"))
    return F.concat_ws("-", F.date_format(start, "MM/dd"), F.date_format(F.date_add(start, days - 1), "MM/dd"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
