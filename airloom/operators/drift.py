"""Distribution drift between a baseline and a current window of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.joins import null_safe_join, staged_join
from airloom.operators.quantiles import exact_quantiles, running_totals


def ks_statistic(df: DataFrame, is_current: Column, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per key."""
    keys = keys or ["parameter"]
    totals = running_totals(
        df, keys, value,
        {"base": F.when(is_current, 0).otherwise(1).cast("long"), "curr": F.when(is_current, 1).otherwise(0).cast("long")},
    )
    sizes = totals.groupBy(*keys).agg(F.sum("base").alias("n_baseline"), F.sum("curr").alias("n_current"))
    gap = F.abs(
        F.try_divide(F.col("base_to_here"), F.col("n_baseline")) - F.try_divide(F.col("curr_to_here"), F.col("n_current"))
    )
    return (
        staged_join(totals, sizes, keys)
        .groupBy(*keys, "n_baseline", "n_current")
        .agg(F.max(gap).alias("ks"))
    )


#: Terms of the Kolmogorov series; at the least argument it is used for, the last one is far below 1e-100.
KS_TERMS = 100
KS_LEAST = 0.25


def kolmogorov(x: Column) -> Column:
    """Probability of a value over ``x`` under the Kolmogorov distribution; below ``KS_LEAST`` it is 1 to seven digits."""

    def with_term(total: Column, j: Column) -> Column:
        return total + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), with_term)
    return F.when(x < KS_LEAST, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_test(df: DataFrame, is_current: Column, keys: list[str] | None = None, value: str = "value", alpha: float = 0.05) -> DataFrame:
    """The distance with its p-value and whether the distributions differ at the level ``alpha``.

    The effective size of the samples is n m / (n + m); an empty one has no
    distance, no p-value and no verdict.
    """
    found = ks_statistic(df, is_current, keys, value)
    n, m = F.col("n_baseline").cast("double"), F.col("n_current").cast("double")
    root = F.sqrt(F.try_divide(n * m, n + m))
    found = found.withColumn("_x", (root + 0.12 + F.try_divide(F.lit(0.11), root)) * F.col("ks"))
    found = found.withColumn("p_value", F.when((n > 0) & (m > 0), kolmogorov(F.col("_x"))))
    return found.drop("_x").withColumn("drifted", F.col("p_value") < alpha)


def population_stability(
    df: DataFrame, is_current: Column, keys: list[str] | None = None, value: str = "value",
    buckets: int = 10, epsilon: float = 1e-6,
) -> DataFrame:
    """PSI per key over buckets cut at the baseline's quantiles."""
    keys = keys or ["parameter"]
    rows = df.select(*keys, F.col(value).alias("_v"), is_current.alias("_current")).where(F.col("_v").isNotNull())
    cuts = {f"_cut{i}": i / buckets for i in range(1, buckets)}
    edges = exact_quantiles(rows.where(~F.col("_current")), keys, "_v", cuts)
    edges = edges.select(*keys, F.array(*cuts).alias("_cuts"))
    placed = staged_join(rows, edges, keys).withColumn(
        "bucket", F.aggregate("_cuts", F.lit(0), lambda n, edge: n + F.when(F.col("_v") > edge, 1).otherwise(0))
    )
    counted = placed.groupBy(*keys, "bucket").agg(
        F.count_if(~F.col("_current")).alias("_base"), F.count_if("_current").alias("_curr")
    )
    # a bucket no reading fell into still counts, with epsilon on both sides: its term is 0
    whole = Window.partitionBy(*keys)
    p = F.greatest(F.try_divide(F.col("_base"), F.sum("_base").over(whole)), F.lit(epsilon))
    q = F.greatest(F.try_divide(F.col("_curr"), F.sum("_curr").over(whole)), F.lit(epsilon))
    terms = counted.withColumn("_p", p).withColumn("_q", q)
    return terms.groupBy(*keys).agg(F.sum((F.col("_q") - F.col("_p")) * F.ln(F.col("_q") / F.col("_p"))).alias("psi"))


def error_drift(daily: DataFrame, days: int = 7, factor: float = 1.5) -> DataFrame:
    """Retrain trigger from (location_id, date, prediction, actual) rows.

    Fires where the trailing mean error exceeds ``factor`` times the location's
    mean error up to that day. Windows run over one row per location and day.
    """
    error = F.abs(F.col("prediction") - F.col("actual"))
    order = Window.partitionBy("location_id").orderBy(F.unix_date("date"))
    recent = F.avg("error").over(order.rangeBetween(-(days - 1), 0))
    so_far = F.avg("error").over(order.rangeBetween(Window.unboundedPreceding, 0))
    return (
        daily.withColumn("error", error)
        .withColumn("recent_error", recent)
        .withColumn("mean_error", so_far)
        .withColumn("retrain", F.col("recent_error") > F.col("mean_error") * factor)
    )


def error_changes(daily: DataFrame, slack: float = 0.1, threshold: float = 1.5) -> DataFrame:
    """Page-Hinkley test for a lasting rise of the error, from (location_id, date, prediction, actual) rows, one a location and day.

    Each day adds its error less ``1 + slack`` times the location's mean error so far. ``excess`` is that running sum less its least
    value up to the day (0 at the start), so it falls back to 0 when the error is as low as before: this is the reset.
    ``since`` is the last day without excess, the estimate of the change point. A day is ``changed`` when the excess is over
    ``threshold`` times the mean error, and the first such day after a reset is the ``alarm``: one for each change.
    A day without an error adds nothing and raises none, though what came before stays. All windows share one order, so there is one
    exchange, of one row a location and day.
    """
    order = Window.partitionBy("location_id").orderBy("date")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = daily.withColumn("error", F.abs(F.col("prediction") - F.col("actual")))
    rows = rows.withColumn("mean_error", F.avg("error").over(up_to))
    rows = rows.withColumn("_sum", F.coalesce(F.sum(F.col("error") - (1 + slack) * F.col("mean_error")).over(up_to), F.lit(0.0)))
    rows = rows.withColumn("excess", F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(up_to)))
    over = F.coalesce(F.col("error").isNotNull() & (F.col("excess") > threshold * F.col("mean_error")), F.lit(False))
    rows = rows.withColumn("changed", over).withColumn("since", F.max(F.when(F.col("excess") == 0, F.col("date"))).over(up_to))
    last = F.max(F.when(F.col("changed"), F.col("date"))).over(before)
    rows = rows.withColumn("_last", last)
    first = F.col("_last").isNull() | F.coalesce(F.col("_last") < F.col("since"), F.lit(False))
    return rows.withColumn("alarm", F.col("changed") & first).drop("_sum", "_last")


def previous_day_forecast(daily: DataFrame) -> DataFrame:
    """Baseline forecast: a day's mean is the mean of the day before."""
    before = daily.select("location_id", F.date_add("date", 1).alias("date"), F.col("mean").alias("prediction"))
    return null_safe_join(daily.withColumnRenamed("mean", "actual"), before, ["location_id", "date"])
