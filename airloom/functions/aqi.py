"""Air-quality index as CASE expressions, so it stays inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from airloom import fixed_values as fixed


def banded_index(concentration: Column, bands, above: int) -> Column:
    """Linear interpolation inside the closed band that holds the value.

    NULL, NaN, negative values and values in the gaps between bands give NULL;
    a value above the last band gives ``above``. Halves round to even.
    """
    branches = []
    for low, high, index_low, index_high in bands:
        slope = (index_high - index_low) / (high - low)
        branches.append((
            concentration.between(float(low), float(high)),
            F.bround(F.lit(slope) * (concentration - F.lit(float(low))) + F.lit(float(index_low)), 0),
        ))
    top = float(bands[-1][1])
    branches.append(((concentration > top) & ~F.isnan(concentration), F.lit(float(above))))
    first, *rest = branches
    case = reduce(lambda acc, b: acc.when(*b), rest, F.when(*first))
    return case.cast("int")


def band_of(concentration: Column, bands) -> Column:
    """The closed band that holds the value, as a struct; NULL in gaps and outside."""
    names = ("band_low", "band_high", "index_low", "index_high")
    case = F.when(F.lit(False), F.struct(*[F.lit(0.0).alias(n) for n in names]))
    for low, high, *index in bands:
        ends = [F.lit(float(low)), F.lit(float(high)), *[F.lit(float(i)) for i in index]]
        case = case.when(concentration.between(low, high), F.struct(*[c.alias(n) for n, c in zip(names, ends)]))
    return case


def aqi_pm25(ug_m3: Column, truncate: bool = False) -> Column:
    """``truncate`` first cuts the concentration to 0.1, which closes the gaps."""
    if truncate:
        # adding a hair keeps 35.4 (stored a little below) at 35.4
        ug_m3 = F.floor(ug_m3 * 10 + 1e-9) / 10
    return banded_index(ug_m3, fixed.PM25_BANDS, fixed.PM25_ABOVE)


def aqi_pm10(ug_m3: Column) -> Column:
    return banded_index(ug_m3, fixed.PM10_BANDS, fixed.PM10_ABOVE)


def aqi_o3(ppm: Column, units: Column | None = None) -> Column:
    """Defined for ppm only; another unit gives NULL when ``units`` is known."""
    index = banded_index(ppm, fixed.O3_BANDS, fixed.O3_ABOVE)
    return index if units is None else F.when(units == "ppm", index)


def overall_aqi(*indices: Column) -> Column:
    """Largest pollutant index of the row, NULLs skipped."""
    return indices[0] if len(indices) == 1 else F.greatest(*indices)


def _by_category(aqi: Column, position: int) -> Column:
    case = F.when(aqi.isNull(), F.lit(fixed.UNKNOWN[position]))
    for limit, *names in fixed.AQI_CATEGORIES:
        case = case.when(aqi <= limit, F.lit(names[position]))
    return case.otherwise(F.lit(fixed.HAZARDOUS[position]))


def aqi_category(aqi: Column) -> Column:
    return _by_category(aqi, 0)


def aqi_color(aqi: Column) -> Column:
    return _by_category(aqi, 1)
