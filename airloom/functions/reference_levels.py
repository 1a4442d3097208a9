"""Guide lines and bands that charts are read against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airloom import fixed_values as fixed


def who_guideline(parameter: Column) -> Column:
    """24 h guideline of the parameter, NULL for all but PM2.5."""
    return F.when(parameter == "pm25", F.lit(fixed.WHO_PM25_24H))


def exceeds_guideline(parameter: Column, value: Column) -> Column:
    return value > who_guideline(parameter)


def aqi_band_top(aqi: Column) -> Column:
    """Upper line of the band an index lies in; NULL above the last line."""
    case = F.when(aqi.isNull(), F.lit(None).cast("int"))
    for limit, _, _ in fixed.AQI_CATEGORIES:
        case = case.when(aqi <= limit, F.lit(limit))
    return case
