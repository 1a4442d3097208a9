"""Forecast: what a forest learns, and the hours it is asked for."""

import random

from pyspark.sql import functions as F

from airloom.operators import models


def readings(spark, days=12):
    """Two places whose PM2.5 follows the local hour, with a little noise; weather is missing at the second."""
    rng, rows, seq = random.Random(1), [], 0
    for place in (1, 2):
        for h in range(24 * days):
            at = f"2025-12-{1 + h // 24:02d} {h % 24:02d}:00:00"
            for name, value in (("pm25", 10.0 + 4 * (h % 24) + rng.random()), ("temperature", 20.0 + h % 5), ("relativehumidity", 50.0)):
                if place == 1 or name == "pm25":
                    rows.append((seq, place, name, value, at))
                    seq += 1
    return spark.createDataFrame(rows, "seq long, location_id long, parameter string, value double, t string").selectExpr(
        "seq", "location_id", "parameter", "value", "CAST(t AS TIMESTAMP_NTZ) AS datetime_utc", "CAST(t AS TIMESTAMP_NTZ) AS datetime_local")


def test_the_held_out_day_is_predicted_better_than_by_the_mean(spark):
    known, held = models.split_by_time(models.training_rows(readings(spark)))
    assert (known.count(), held.count()) == (2 * 24 * 11, 48)
    mean = known.agg(F.avg("pm25")).first()[0]
    scored = models.random_forest(known).transform(held)
    errors = scored.agg(
        F.sqrt(F.avg((F.col("pm25") - F.col("prediction")) ** 2)).alias("forest"), F.sqrt(F.avg((F.col("pm25") - mean) ** 2)).alias("mean")).first()
    assert errors.forest < errors["mean"] / 2


def test_the_next_day_of_each_place_is_asked_for(spark):
    rows = models.training_rows(readings(spark))
    ahead = models.coming_hours(rows).orderBy("location_id", "hours_ahead").collect()
    assert [(r.location_id, r.hours_ahead, r.hour) for r in ahead] == [(p, h + 1, h) for p in (1, 2) for h in range(24)]
    assert {str(r.datetime_utc)[:10] for r in ahead} == {"2025-12-13"} and all(r.temperature is not None for r in ahead)
    assert models.coming_hours(rows.where("false")).count() == 0
