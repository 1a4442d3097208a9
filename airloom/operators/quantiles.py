"""Exact quantiles and running totals that never gather a whole group.

``percentile`` keeps every distinct value of a group in one buffer. Here a
group is cut into value buckets first: bucket counts locate the wanted ranks,
and only rows of the few buckets that hold them are looked at by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.joins import null_safe_join
from airloom.session import stage

# Buckets are 1/32 wide on the natural log scale (3% of the value).
LOG_STEPS = 32
# Larger than -ln(smallest positive double) * LOG_STEPS.
LOG_SHIFT = 746 * LOG_STEPS
# Values one task should order; sizes tasks, changes no result.
VALUES_PER_CELL = 50_000
LARGEST = 1.7976931348623157e308


def value_bucket(value: str) -> Column:
    """Bucket number that never falls while the value rises."""
    size = f"floor(ln(least(abs({value}), double('{LARGEST}'))) * {LOG_STEPS}) + {LOG_SHIFT}"
    return F.expr(f"CASE WHEN {value} > 0 THEN {size} WHEN {value} < 0 THEN -({size}) ELSE 0L END")


def _cell(cells: str | int) -> Column:
    """Place of ``_v`` between the bucket's own lowest and highest value."""
    return F.expr(f"CASE WHEN _hi > _lo THEN floor((_v - _lo) / (_hi - _lo) * {cells}) ELSE 0L END")


def _numbers(df: DataFrame, keys: list[str], value: str, *extra: Column) -> DataFrame:
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), *extra).where("_v IS NOT NULL AND NOT isnan(_v)")
    return rows.withColumn("_b", value_bucket("_v"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per key with a linearly interpolated quantile per name."""
    rows = _numbers(df, keys, value)
    positions = {name: f"(double('{p}') * (_total - 1))" for name, p in probabilities.items()}
    ranks = list(dict.fromkeys(f"{end}({at})" for at in positions.values() for end in ("floor", "ceil")))

    def holds(start: str, end: str) -> str:
        return " OR ".join(f"({r} >= {start} AND {r} < {end})" for r in ranks)

    # 1. counts per bucket: some hundred rows per key, and which of them hold a wanted rank
    buckets = rows.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    targets = buckets.select(
        "*", F.sum("_n").over(running).alias("_end"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total")
    ).where(holds("_end - _n", "_end"))
    targets = stage(
        targets.selectExpr(*keys, "_b", "_lo", "_hi", "_total", "_end - _n AS _start", "_n AS _rows"), "quantile_buckets"
    )

    # 2. cells of those buckets that hold a wanted rank, counted by value, with the running rank of each value
    chosen, group = _narrow(null_safe_join(rows, targets, [*keys, "_b"]), keys, holds)
    values = chosen.groupBy(*group, "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_start").alias("_start"), F.min("_total").alias("_total")
    )
    ordered = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.select(*keys, "_v", "_n", "_total", (F.col("_start") + F.sum("_n").over(ordered)).alias("_end"))

    # 3. interpolate between the two neighbours of each position
    def at_rank(rank: str) -> str:
        return f"max(CASE WHEN {rank} >= _end - _n AND {rank} < _end THEN _v END)"

    out = []
    for name, at in positions.items():
        low, high = at_rank(f"floor({at})"), at_rank(f"ceil({at})")
        out.append(F.expr(f"{low} + ({high} - {low}) * max({at} - floor({at}))").alias(name))
    return ranked.groupBy(*keys).agg(*out)


def _narrow(chosen: DataFrame, keys: list[str], holds) -> tuple[DataFrame, list[str]]:
    """Cut wanted buckets into cells by their own row count and keep the cells that hold a wanted rank."""
    bucket, group = [*keys, "_b"], [*keys, "_b", "_cell"]
    placed = chosen.withColumn("_cell", _cell(f"ceil(_rows / {VALUES_PER_CELL})"))
    counted = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_cn"), F.min("_start").alias("_bucket_start"), F.min("_total").alias("_total")
    )
    running = Window.partitionBy(*bucket).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.select("*", (F.col("_bucket_start") + F.sum("_cn").over(running)).alias("_cend"))
    cells = ends.where(holds("_cend - _cn", "_cend")).selectExpr(*group, "_cend - _cn AS _cstart")
    kept = null_safe_join(placed, stage(cells, "quantile_cells"), group)
    return kept.drop("_start").withColumnRenamed("_cstart", "_start"), group


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def running_totals(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """Per key and distinct value: totals of the measures up to that value.

    The order is cut at bucket and cell borders. Totals before each cell come
    from a small table, so the ordered runs inside cells are independent.
    """
    names = list(measures)
    rows = _numbers(df, keys, value, *[c.alias(n) for n, c in measures.items()])
    values = stage(
        rows.groupBy(*keys, "_b", "_v").agg(*[F.sum(n).alias(n) for n in names]), "value_totals"
    )
    buckets = values.groupBy(*keys, "_b").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.ceil(F.count(F.lit(1)) / VALUES_PER_CELL).alias("_cells"),
    )
    placed = null_safe_join(values, stage(buckets, "value_buckets"), [*keys, "_b"]).withColumn(
        "_cell", _cell("_cells")
    )
    before = Window.partitionBy(*keys).orderBy("_b", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*keys, "_b", "_cell").agg(*[F.sum(n).alias(f"_sum_{n}") for n in names])
    cells = cells.select(
        *keys, "_b", "_cell",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in names],
    )
    inside = Window.partitionBy(*keys, "_b", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_join(placed, cells, [*keys, "_b", "_cell"]).select(
        *keys, F.col("_v").alias(value), *names,
        *[(F.col(f"_before_{n}") + F.sum(n).over(inside)).alias(f"{n}_to_here") for n in names],
    )
