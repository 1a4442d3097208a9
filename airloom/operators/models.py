"""Forecast models of PM2.5 on the wide table, trained by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.operators.joins import null_safe_join
from airloom.operators.pivot import pivot_first
from airloom.operators.rolling import rolling_mean
from airloom.session import stage

WEATHER = ["temperature", "relativehumidity"]
FEATURES = ["hour", "day_of_week", *WEATHER]


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.hour("datetime_local")).withColumn("day_of_week", F.weekday("datetime_local"))


def feature_table(df: DataFrame, hours: int = 24) -> DataFrame:
    """Label, weather, time features and trailing PM2.5 mean, one row per place and time."""
    wide = pivot_first(df, ["pm25", *WEATHER])
    trailing = rolling_mean(df.where("parameter = 'pm25'"), ["location_id"], hours).drop("readings")
    return null_safe_join(_timed(wide), trailing, ["location_id", "datetime_utc"], "left")


def training_rows(df: DataFrame) -> DataFrame:
    """Rows with a label, stored once for fitting and scoring; a missing weather reading becomes the mean of the training set."""
    wide = pivot_first(df, ["pm25", *WEATHER]).where("pm25 IS NOT NULL")
    rows = stage(_timed(wide).select("location_id", "datetime_utc", "datetime_local", "pm25", *FEATURES), "training_rows")
    return rows.withColumns({c: F.coalesce(F.col(c), rows.agg(F.avg(c)).scalar(), F.lit(0.0)) for c in WEATHER})


def split_by_time(rows: DataFrame, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from, and those of the last hours of the data, held out."""
    cut = rows.agg(F.max("datetime_utc") - F.make_dt_interval(hours=F.lit(hours))).scalar()
    return rows.where(F.col("datetime_utc") <= cut), rows.where(F.col("datetime_utc") > cut)


def coming_hours(rows: DataFrame, hours: int = 24) -> DataFrame:
    """Features of the hours after each location's last row.

    The weather to come is the location's mean at that hour of the day, else its mean over all hours.
    """
    last = rows.groupBy("location_id").agg(
        F.max("datetime_utc").alias("_last"), F.max("datetime_local").alias("_local"),
        *[F.avg(c).alias(f"_any_{c}") for c in WEATHER],
    ).withColumn("hours_ahead", F.explode(F.sequence(F.lit(1), F.lit(hours))))
    step = F.make_dt_interval(hours=F.col("hours_ahead"))
    ahead = _timed(last.withColumns({"datetime_utc": F.col("_last") + step, "datetime_local": F.col("_local") + step}))
    usual = rows.groupBy("location_id", "hour").agg(*[F.avg(c).alias(f"_usual_{c}") for c in WEATHER])
    known = null_safe_join(ahead, usual, ["location_id", "hour"], "left")
    return known.select(
        "location_id", "datetime_utc", "hours_ahead", "hour", "day_of_week",
        *[F.coalesce(f"_usual_{c}", f"_any_{c}").alias(c) for c in WEATHER],
    )


def random_forest(rows: DataFrame, trees: int = 20, depth: int = 5, seed: int = 42):
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestRegressor(featuresCol="features", labelCol="pm25", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assembler, forest]).fit(rows)


def linear_baseline(rows: DataFrame, features: list[str]):
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    line = LinearRegression(featuresCol="features", labelCol="pm25", solver="normal", standardization=False)
    return Pipeline(stages=[assembler, line]).fit(rows)
