"""Lookups of values in ranges that are a table: an equi-join on cells in place of a comparison with every range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom.operators.joins import null_safe_join
from airloom.session import stage

CELLS = 256


def _cell(at: Column, cells: int) -> Column:
    """The cell of a value on its key's grid; values off the grid fall into the outermost cells."""
    place = F.floor((at - F.col("_first")) / F.col("_width"))
    return F.least(F.greatest(place, F.lit(0)), F.lit(cells - 1)).cast("int")


def in_ranges(
    rows: DataFrame, ranges: DataFrame, on: list[str], value: str = "value", how: str = "left", low: str = "low", high: str = "high",
    low_open: str | None = None, cells: int = CELLS,
) -> DataFrame:
    """Rows with the columns of each range of their key that holds the value; ``how="left"`` keeps rows without one.

    Ranges are closed; ``low_open`` names a column that says where the low end is
    left out. A missing end is no end. Each key's ranges lie on a grid of
    ``cells`` cells, and a range is listed once per cell it reaches into. A value has one
    cell, so a range matches it once, and overlapping ranges each match. NULL and NaN are in no range.
    """
    ends = F.coalesce(low, high), F.coalesce(high, low)
    grid = ranges.groupBy(*on).agg(F.min(ends[0]).cast("double").alias("_first"), F.max(ends[1]).cast("double").alias("_last"))
    width = F.greatest((F.col("_last") - F.col("_first")) / cells, F.lit(1e-300))
    grid = stage(grid.select(*on, "_first", width.alias("_width")), "grid")
    first = F.when(F.col(low).isNull(), 0).otherwise(_cell(F.col(low), cells))
    last = F.when(F.col(high).isNull(), cells - 1).otherwise(_cell(F.col(high), cells))
    named = [F.col(c).alias(f"_range_{c}") if c in (*on, low, high) else F.col(c) for c in ranges.columns]
    listed = null_safe_join(ranges, grid, on).select(*named, F.explode(F.sequence(first, F.greatest(first, last))).alias("_range_cell"))
    listed = stage(listed, "range_cells")

    known = F.when(~F.isnan(value), F.col(value))
    placed = null_safe_join(rows, grid, on, "left").withColumn("_cell", _cell(known, cells)).drop("_first", "_width")
    begin, end = F.col(f"_range_{low}"), F.col(f"_range_{high}")
    after = known >= begin
    if low_open is not None:
        after = F.when(F.col(low_open), known > begin).otherwise(after)
    same = F.expr(" AND ".join(f"`{c}` <=> `_range_{c}`" for c in on))
    inside = same & (F.col("_cell") == F.col("_range_cell")) & (begin.isNull() | after) & (end.isNull() | (known <= end))
    found = placed.join(listed, inside, how).drop("_cell", "_range_cell", *[f"_range_{c}" for c in on])
    return found.withColumnsRenamed({f"_range_{low}": low, f"_range_{high}": high})


def index_bands(spark: SparkSession) -> DataFrame:
    """The index bands as a table: ``parameter, low, high, index_low, index_high, low_open``; the last band has no end."""
    rows = []
    for parameter, bands, above in (("pm25", fixed.PM25_BANDS, fixed.PM25_ABOVE), ("pm10", fixed.PM10_BANDS, fixed.PM10_ABOVE), ("o3", fixed.O3_BANDS, fixed.O3_ABOVE)):
        rows += [(parameter, *map(float, band), False) for band in bands]
        rows.append((parameter, float(bands[-1][1]), None, float(above), float(above), True))
    return spark.createDataFrame(rows, "parameter string, low double, high double, index_low double, index_high double, low_open boolean")


def index_from_bands(rows: DataFrame, bands: DataFrame, value: str = "value") -> DataFrame:
    """Rows with ``aqi``, interpolated inside the band of the table that holds the value; none gives NULL."""
    placed = in_ranges(rows, bands, ["parameter"], value, low_open="low_open")
    slope = (F.col("index_high") - F.col("index_low")) / (F.col("high") - F.col("low"))
    inside = F.bround(slope * (F.col(value) - F.col("low")) + F.col("index_low"), 0)
    index = F.when(F.col("high").isNull(), F.col("index_low")).otherwise(inside).cast("int")
    return placed.select(*rows.columns, index.alias("aqi"))
