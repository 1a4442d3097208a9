from datetime import datetime

import pytest
from pyspark.sql import functions as F

from airloom.functions import aqi, calendar, reference_levels, text


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, kind, fn):
    rows = column(spark, values, kind).select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_pm25_bands_edges_gaps_and_cap(spark):
    values = [0.0, 12.0, 12.05, 12.1, 35.4, 35.45, 35.5, 55.4, 150.4, 250.4, 500.4, 500.5, -1.0, None, float("nan")]
    want = [0, 50, None, 51, 100, None, 101, 150, 200, 300, 500, 500, None, None, None]
    assert apply(spark, values, "double", aqi.aqi_pm25) == want


def test_pm25_truncated_has_no_gaps(spark):
    values = [12.05, 35.45, 55.44, 150.49, 250.46, 35.4]
    got = apply(spark, values, "double", lambda c: aqi.aqi_pm25(c, truncate=True))
    assert got == [50, 100, 150, 200, 300, 100]


def test_pm10_and_o3_bands(spark):
    assert apply(spark, [0.0, 54.0, 54.5, 55.0, 604.0, 605.0], "double", aqi.aqi_pm10) == [0, 50, None, 51, 500, 500]
    assert apply(spark, [0.0, 0.054, 0.0545, 0.055, 0.2, 0.21], "double", aqi.aqi_o3) == [0, 50, None, 51, 300, 300]


def test_index_rounds_half_to_even(spark):
    # 50 / 54 * 13.5 = 12.5 and 50 / 54 * 14.58 = 13.5
    got = apply(spark, [13.5, 14.58], "double", aqi.aqi_pm10)
    assert got == [12, 14]


def test_o3_needs_ppm(spark):
    df = spark.createDataFrame([(0.05, "ppm"), (0.05, "µg/m³"), (0.05, None)], "v double, u string")
    assert [r.y for r in df.select(aqi.aqi_o3(F.col("v"), F.col("u")).alias("y")).collect()] == [46, None, None]


def test_categories_of_fractional_means(spark):
    values = [50.0, 50.4, 100.0, 150.0, 200.0, 300.0, 300.1, None]
    names = apply(spark, values, "double", aqi.aqi_category)
    assert names == [
        "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy", "Hazardous", "Unknown",
    ]
    assert apply(spark, values, "double", aqi.aqi_color)[-2:] == ["maroon", "gray"]


def test_overall_skips_missing_pollutants(spark):
    df = spark.createDataFrame([(10, None), (None, 20), (30, 20), (None, None)], "a int, b int")
    assert [r.y for r in df.select(aqi.overall_aqi(F.col("a"), F.col("b")).alias("y")).collect()] == [10, 20, 30, None]


def test_local_time_keeps_the_wall_clock(spark):
    texts = ["2025-12-05T17:45:00+05:45", "2025-12-05T17:45:00Z", "nonsense", None]
    local = apply(spark, texts, "string", calendar.parse_local)
    assert local == [datetime(2025, 12, 5, 17, 45), datetime(2025, 12, 5, 17, 45), None, None]
    utc = apply(spark, texts, "string", calendar.parse_utc)
    assert utc[:3] == [datetime(2025, 12, 5, 12, 0), datetime(2025, 12, 5, 17, 45), None]
    assert apply(spark, texts, "string", calendar.utc_offset)[:2] == ["+05:45", "Z"]


def test_iso_check(spark):
    texts = ["2025-12-05T12:00:00Z", "2025-12-05", "2025", "yesterday", "2025-13-05T12:00:00Z", "2025-12-05T12:00:00.5+05:45"]
    assert apply(spark, texts, "string", calendar.is_iso) == [True, True, False, False, False, True]


def test_period_labels(spark):
    day = [datetime(2025, 12, 1), datetime(2025, 12, 7, 23), datetime(2024, 12, 31)]
    assert apply(spark, day, "timestamp_ntz", calendar.week_label) == [
        "2025-12-01/2025-12-07", "2025-12-01/2025-12-07", "2024-12-30/2025-01-05",
    ]
    assert apply(spark, day, "timestamp_ntz", calendar.month_label) == ["2025-12", "2025-12", "2024-12"]
    assert apply(spark, day, "timestamp_ntz", calendar.day_name) == ["Monday", "Sunday", "Tuesday"]


@pytest.mark.parametrize("days, unit", [(60, "Day"), (61, "Week"), (365, "Week"), (366, "Month")])
def test_granularity_limits(spark, days, unit):
    assert apply(spark, [days], "int", calendar.granularity) == [unit]


def test_elapsed_days_are_whole(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' a, TIMESTAMP_NTZ '2024-01-02 23:00:00' b")
    assert df.select(calendar.elapsed_days(F.col("a"), F.col("b"))).first()[0] == 1


def test_fifteen_day_buckets(spark):
    df = spark.sql("SELECT DATE '2025-01-01' f, explode(array(DATE '2025-01-15', DATE '2025-01-16', DATE '2026-01-01')) d")
    number = calendar.bucket_number(F.col("d"), F.col("f"))
    rows = df.select(number.alias("n"), calendar.bucket_label(F.col("f"), number).alias("l")).collect()
    assert [(r.n, r.l) for r in rows] == [(0, "01/01-01/15"), (1, "01/16-01/30"), (24, "12/27-01/10")]


def test_keys_treat_missing_parts_as_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, None)], "a int, b string, c string")
    assert [r.k for r in df.select(text.joined_key(F.col("a"), F.col("b"), F.col("c")).alias("k")).collect()] == ["1__x", "__"]


def test_location_id_from_path(spark):
    paths = ["file:/d/location_6142174.json", "file:/d/location_id=7/part-0.txt", "file:/d/other.json"]
    assert apply(spark, paths, "string", text.location_id_from_path) == [6142174, 7, None]


def test_number_formats(spark):
    assert apply(spark, [37155], "long", text.thousands) == ["37,155"]
    assert apply(spark, [34.6449], "double", lambda c: text.decimals(c, 2)) == ["34.64"]


def test_guideline_is_for_pm25_only(spark):
    df = spark.createDataFrame([("pm25", 15.0), ("pm25", 15.1), ("pm1", 99.0)], "p string, v double")
    got = df.select(reference_levels.exceeds_guideline(F.col("p"), F.col("v")).alias("e")).collect()
    assert [r.e for r in got] == [False, True, None]


def test_band_top(spark):
    assert apply(spark, [0, 50, 51, 300, 301, None], "int", reference_levels.aqi_band_top) == [50, 50, 100, 300, None, None]


def test_utc_parsing_in_another_session_zone(spark):
    from airloom.functions import calendar

    texts = ["2025-12-05T12:00:00Z", "2025-12-05T17:45:00+05:45", "2025-12-05T12:00:00", "2025-12-05 07:00:00-05", "2025-12-05", "soon", None]

    def parsed() -> list:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        return [r.u for r in df.select(calendar.parse_utc(F.col("t")).cast("string").alias("u")).collect()]

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = parsed()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    noon = "2025-12-05 12:00:00"
    assert got == [noon] * 4 + ["2025-12-05 00:00:00", None, None] == parsed()
