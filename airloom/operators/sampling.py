"""Samples, latest records and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom import fixed_values as fixed


def random_order(id_column: str, seed: int) -> Column:
    """Text that orders rows at random, the same way on every run and engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_column).cast("string")))


def random_sample(df: DataFrame, size: int, id_column: str = "seq", seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows without replacement; every row if there are fewer.

    Rows fall into 65,536 buckets of the random order. Whole buckets are taken
    up to the border one, and only that one is ranked.
    """
    rows = df.withColumn("_order", random_order(id_column, seed)).withColumn(
        "_bucket", F.substring("_order", 1, 4)
    )
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    border = (
        rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto))
        .where(F.col("_end") >= size)
        .agg(
            F.min("_bucket").alias("_border"),
            (F.lit(size) - F.min_by(F.col("_end") - F.col("_n"), "_bucket")).alias("_rest"),
        )
    )
    rows = rows.withColumn("_at", border.select(F.struct("_border", "_rest")).scalar()).select(
        *df.columns, "_order", "_bucket", "_at._border", "_at._rest"
    )
    whole = rows.where(F.col("_border").isNull() | (F.col("_bucket") < F.col("_border")))
    ranked = Window.partitionBy("_bucket").orderBy("_order", id_column)
    part = (
        rows.where(F.col("_bucket") == F.col("_border"))
        .withColumn("_rn", F.row_number().over(ranked))
        .where(F.col("_rn") <= F.col("_rest"))
        .drop("_rn")
    )
    return whole.unionByName(part).drop("_order", "_bucket", "_border", "_rest")


def latest_per_location(df: DataFrame, n: int = fixed.LATEST_RECORDS) -> DataFrame:
    """Last n records of each location; the limit already runs before the shuffle."""
    newest = Window.partitionBy("location_id").orderBy(F.desc("datetime_utc"), F.desc("seq"))
    return df.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)
