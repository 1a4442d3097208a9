"""Histogram, box-plot and violin summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom.operators.joins import null_safe_join
from airloom.operators.periods import with_periods
from airloom.operators.quantiles import exact_quantiles
from airloom.session import stage

PERIOD = ["parameter", "unit", "time_period"]
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
#: Bins a bandwidth, and the bandwidths beyond which the kernel (under 3e-16) is left out.
DENSITY_BINS = 16
KERNEL_REACH = 8.5


def histogram(df: DataFrame, keys: list[str], value: str = "value", bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins per key, empty ones included; the last bin is closed.

    A group of one single value gets a range half a unit to either side.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    single = F.min("_v") == F.max("_v")
    ranges = stage(
        rows.groupBy(*keys).agg(
            F.when(single, F.min("_v") - 0.5).otherwise(F.min("_v")).alias("_lo"),
            F.when(single, F.max("_v") + 0.5).otherwise(F.max("_v")).alias("_hi"),
        ),
        "histogram_ranges",
    )
    number = F.least(F.width_bucket("_v", "_lo", "_hi", F.lit(bins)), F.lit(bins))
    counted = (
        null_safe_join(rows, ranges, keys)
        .groupBy(*keys, number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return null_safe_join(frame, counted, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("_lo") + width * (F.col("bin") - 1)).alias("bin_start"),
        (F.col("_lo") + width * F.col("bin")).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n"),
    )


def box_quartiles(df: DataFrame, keep: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows joined to their period's quartiles and fences, and the fences."""
    rows = with_periods(df.where("value IS NOT NULL"), keep)
    quartiles = exact_quantiles(rows, PERIOD, "value", QUARTILES)
    reach = (F.col("q3") - F.col("q1")) * fixed.WHISKER_REACH
    fences = quartiles.withColumn("fence_low", F.col("q1") - reach).withColumn("fence_high", F.col("q3") + reach)
    fences = stage(fences, "box_fences")
    return null_safe_join(rows, fences, PERIOD), fences


def box_summary(df: DataFrame, keep: int | None = None) -> DataFrame:
    """Quartiles, whiskers (reach 1.5 IQR, ending on data) and outlier count of every period, or of those a drawing keeps."""
    rows, _ = box_quartiles(df, keep)
    v = F.col("value")
    inside = v.between(F.col("fence_low"), F.col("fence_high"))
    return rows.groupBy(*PERIOD, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, v)).alias("_low"),
        F.max(F.when(inside, v)).alias("_high"),
        F.count_if(~inside).alias("outliers"),
    ).select(
        *PERIOD, "n", "q1", "median", "q3",
        F.least("_low", "q1").alias("whisker_low"),
        F.greatest("_high", "q3").alias("whisker_high"),
        "outliers",
    )


def box_outliers(df: DataFrame, keep: int | None = None) -> DataFrame:
    """The readings drawn outside the whiskers."""
    rows, _ = box_quartiles(df, keep)
    outside = ~F.col("value").between(F.col("fence_low"), F.col("fence_high"))
    return rows.where(outside).select("seq", "location_id", *PERIOD, "value")


def violin_quartiles(df: DataFrame, keep: int | None = None) -> DataFrame:
    return exact_quantiles(with_periods(df, keep), PERIOD, "value", QUARTILES)


def violin_density(df: DataFrame, keep: int | None = None, points: int = fixed.DENSITY_POINTS) -> DataFrame:
    """Gaussian density on an even grid, Scott bandwidth, two bandwidths of margin.

    Equal values are counted before they meet the grid. Groups without spread
    have no curve.
    """
    rows = with_periods(df.where("value IS NOT NULL"), keep)
    groups = (
        rows.groupBy(*PERIOD)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
            (F.stddev_samp("value") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("bandwidth"),
        )
        .where("bandwidth > 0")
    )
    cut = fixed.DENSITY_CUT
    grid = groups.selectExpr(
        *PERIOD, "n", "bandwidth", f"_lo - {cut}D * bandwidth AS _start",
        f"(_hi - _lo + {2 * cut}D * bandwidth) / {points - 1} AS _step", "monotonically_increasing_id() AS _group",
    )
    grid = stage(grid, "density_grid")  # numbers the groups once and for all
    values = rows.groupBy(*PERIOD, "value").agg(F.count(F.lit(1)).alias("copies"))
    # each value becomes a hundred points: spread by number, as bytes say little about the work
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = null_safe_join(values.repartition(tasks, *PERIOD, "value"), grid, PERIOD)
    sums = (
        placed.selectExpr("_group", "value", "copies", "bandwidth", "_start", "_step", f"explode(sequence(0, {points - 1})) AS point")
        .withColumn("_z", F.expr("(_start + _step * point - value) / bandwidth"))
        .groupBy("_group", "point").agg(F.sum(F.expr("copies * exp(_z * _z * -0.5D)")).alias("_sum"))
    )
    area = F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    return sums.join(grid, "_group").select(
        *PERIOD, "n", "bandwidth", "point", F.expr("_start + _step * point").alias("x"), (F.col("_sum") / area).alias("density")
    )


def binned_density_error(bandwidth: float, bins: int = DENSITY_BINS) -> float:
    """How far ``binned_density`` is at most from the density of the values themselves, at any point.

    Linear interpolation of a kernel over bins of width d is off by at most d * d / 8 times its largest second derivative.
    """
    return 1 / (8 * bins**2 * bandwidth * math.sqrt(2 * math.pi))


def density_bins(rows: DataFrame, grid: DataFrame, bins: int = DENSITY_BINS) -> DataFrame:
    """One row for each occupied bin of a group: ``copies`` and ``to_next``, the part of them that the bin's upper end takes."""
    placed = null_safe_join(rows, grid, PERIOD).selectExpr(
        "_group", "bandwidth", "_start", "_step", "_lo", f"(value - _lo) / bandwidth * {bins}D AS _at"
    )
    return placed.groupBy("_group", "bandwidth", "_start", "_step", "_lo", F.floor("_at").alias("bin")).agg(
        F.count(F.lit(1)).alias("copies"), F.sum(F.col("_at") - F.floor("_at")).alias("to_next")
    )


def binned_density(df: DataFrame, keep: int | None = None, points: int = fixed.DENSITY_POINTS, bins: int = DENSITY_BINS) -> DataFrame:
    """The curves of ``violin_density`` from linear bins: the cost after one pass over the rows is bins, not values.

    Each value is shared by the two ends of its bin, a part of the bandwidth wide, and a bin meets the grid points within
    the kernel's reach only. A group of R bandwidths has some R * bins bins, each of which meets 17 * points / R points, so
    no group makes more than about 17 * bins * points rows. Nulls, NaN and infinite values are left out; groups without spread have no curve.
    """
    rows = with_periods(df.where("abs(value) < double('Infinity')"), keep).select(*PERIOD, "value")
    groups = (
        rows.groupBy(*PERIOD)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
            (F.stddev_samp("value") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("bandwidth"),
        )
        .where("bandwidth > 0")
    )
    cut = fixed.DENSITY_CUT
    grid = groups.selectExpr(
        *PERIOD, "n", "bandwidth", "_lo", f"_lo - {cut}D * bandwidth AS _start",
        f"(_hi - _lo + {2 * cut}D * bandwidth) / {points - 1} AS _step", "monotonically_increasing_id() AS _group",
    )
    grid = stage(grid, "density_grid")  # numbers the groups once and for all
    low = F.expr(f"_lo + bandwidth / {bins}D * bin")
    first = F.expr(f"int(greatest(0, ceil((_low - {KERNEL_REACH}D * bandwidth - _start) / _step)))")
    last = F.expr(f"int(least({points - 1}, floor((_high + {KERNEL_REACH}D * bandwidth - _start) / _step)))")
    met = (
        density_bins(rows, grid, bins)
        .withColumn("_low", low).withColumn("_high", F.expr(f"_low + bandwidth / {bins}D"))
        .withColumns({"_first": first, "_last": last})
        .where("_first <= _last")  # a bin between two points that are far apart meets neither
        .withColumn("point", F.explode(F.sequence("_first", "_last")))
        .withColumn("_x", F.expr("_start + _step * point"))
        .withColumns({"_to_low": F.expr("(_x - _low) / bandwidth"), "_to_high": F.expr("(_x - _high) / bandwidth")})
    )
    share = F.expr("(copies - to_next) * exp(_to_low * _to_low * -0.5D) + to_next * exp(_to_high * _to_high * -0.5D)")
    sums = met.groupBy("_group", "point").agg(F.sum(share).alias("_sum"))
    frame = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    area = F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    return frame.join(sums, ["_group", "point"], "left").select(
        *PERIOD, "n", "bandwidth", "point", F.expr("_start + _step * point").alias("x"), (F.coalesce("_sum", F.lit(0.0)) / area).alias("density")
    )
