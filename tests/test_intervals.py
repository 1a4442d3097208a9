"""Range lookups beside a loop over all ranges, index bands from a table, and the Kolmogorov series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from airloom.functions import aqi
from airloom.operators import drift, intervals

RANGES = "key string, name string, low double, high double, low_open boolean"


def held(rows, ranges):
    """(id, name) of every range that holds a row's value."""
    out = []
    for i, k, v in rows:
        names = [
            n for rk, n, lo, hi, is_open in ranges
            if rk == k and v is not None and not math.isnan(v) and (lo is None or v > lo or (v == lo and not is_open)) and (hi is None or v <= hi)
        ]
        out += [(i, n) for n in names or [None]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [1, 7, 256])
def test_beside_all_ranges(spark, cells):
    random.seed(cells)
    ranges = [("a", f"r{i}", (lo := round(random.uniform(0, 50), 1)), lo + random.choice([0.0, 0.3, 20.0]), random.random() < 0.3) for i in range(30)]
    ranges += [("a", "all above", 40.0, None, True), ("a", "all below", None, 2.0, False), ("b", "point", 5.0, 5.0, False), (None, "no key", 0.0, 9.0, False)]
    values = [r[2] for r in ranges if r[2] is not None] + [r[3] for r in ranges if r[3] is not None] + [random.uniform(-9, 90) for _ in range(60)] + [None, float("nan"), float("inf"), -0.0]
    rows = [(100 * j + i, k, v) for i, v in enumerate(values) for j, k in enumerate(["a", "b", "none", None])]
    found = intervals.in_ranges(spark.createDataFrame(rows, "id long, key string, value double"), spark.createDataFrame(ranges, RANGES), ["key"], low_open="low_open", cells=cells)
    assert sorted(((r.id, r.name) for r in found.collect()), key=repr) == held(rows, ranges)


def test_inner_and_empty(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 9.0)], "id long, key string, value double")
    ranges = spark.createDataFrame([("a", "r", 0.0, 2.0, False)], RANGES)
    assert [r.id for r in intervals.in_ranges(rows, ranges, ["key"], how="inner").collect()] == [1]
    assert intervals.in_ranges(rows, ranges.limit(0), ["key"]).where("name IS NULL").count() == 2
    assert intervals.in_ranges(rows.limit(0), ranges, ["key"]).count() == 0


def test_index_equals_the_generated_bands(spark):
    values = [None, -1.0, 0.0, 12.0, 12.05, 12.1, 35.4, 35.45, 150.4, 500.4, 500.5, 1e9, 0.054, 0.0545, 0.2, 0.21, 54.0, 54.5, 604.0, 605.0] + [i / 7 for i in range(4000)]
    rows = spark.createDataFrame([(p, v) for p in ("pm25", "pm10", "o3", "pm1") for v in values], "parameter string, value double")
    v = F.col("value")
    want = F.when(F.col("parameter") == "pm25", aqi.aqi_pm25(v)).when(F.col("parameter") == "pm10", aqi.aqi_pm10(v)).when(F.col("parameter") == "o3", aqi.aqi_o3(v))
    found = intervals.index_from_bands(rows, intervals.index_bands(spark))
    assert found.where(~F.col("aqi").eqNullSafe(want)).count() == 0 and found.count() == rows.count()


def test_plan_is_an_equi_join(spark):
    rows = spark.range(10).select(F.when(F.col("id") % 2 == 0, "pm25").otherwise("o3").alias("parameter"), F.col("id").cast("double").alias("value"))
    plan = intervals.index_from_bands(rows, intervals.index_bands(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "HashJoin" in plan


def test_kolmogorov_beside_the_plain_sum(spark):
    points = [0.01 * i for i in range(300)]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in points], "x double").select(drift.kolmogorov(F.col("x"))).collect()]
    for x, p in zip(points, found):
        # below 1 the other form of the series converges fast
        want = 1 - math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * j - 1) * math.pi / x) ** 2 / 8) for j in range(1, 60)) if x else 1.0
        assert p == pytest.approx(want, abs=1e-6)


def test_ks_test_with_an_empty_side(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True), ("b", 1.0, True), ("b", 1.0, False)], "parameter string, value double, now boolean")
    found = {r.parameter: (r.ks, r.p_value, r.drifted) for r in drift.ks_test(rows, F.col("now")).collect()}
    assert found == {"a": (None, None, None), "b": (0.0, 1.0, False)}
