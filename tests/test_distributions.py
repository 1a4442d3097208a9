import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airloom.operators import distribution, periods, quantiles, rolling, sampling

PROBS = {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p999": 0.999}


def skewed_frame() -> pd.DataFrame:
    """One key holds most rows, one value a third of them; signs, zeros and outliers."""
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.full(3000, 7.25), rng.normal(0, 50, 4000).round(2), [1e12, -1e12, 0.0]])
    parts = [("hot", v) for v in hot]
    parts += [("pressure", v) for v in rng.normal(1013, 0.5, 900)]
    parts += [("tiny", v) for v in rng.random(40) * 1e-6]
    parts += [("one", 4.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    return pd.DataFrame(parts, columns=["key", "v"])


def frame_quantiles(pdf):
    return {k: [np.quantile(g, p) for p in PROBS.values()] for k, g in pdf.dropna().groupby("key")["v"]}


@pytest.mark.parametrize("rows_per_cell", [5, 300, 50_000])
def test_exact_quantiles_on_skewed_groups(spark, monkeypatch, rows_per_cell):
    monkeypatch.setattr(quantiles, "VALUES_PER_CELL", rows_per_cell)
    pdf = skewed_frame()
    df = spark.createDataFrame(pdf, "key string, v double")
    got = {r["key"]: [r[p] for p in PROBS] for r in quantiles.exact_quantiles(df, ["key"], "v", PROBS).collect()}
    want = frame_quantiles(pdf)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-12)


def test_exact_quantiles_with_missing_key_and_no_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "key string, v double")
    rows = quantiles.exact_quantiles(df, ["key"], "v", {"m": 0.5}).collect()
    assert {r["key"]: r["m"] for r in rows} == {None: 2.0, "a": 5.0}
    assert quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 3.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=40))
def test_value_bucket_never_falls(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = df.select("v", quantiles.value_bucket("v").alias("b")).orderBy("v").collect()
    buckets = [r.b for r in rows]
    assert buckets == sorted(buckets)


def test_running_totals_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "VALUES_PER_CELL", 5)
    pdf = skewed_frame().dropna()
    df = spark.createDataFrame(pdf, "key string, v double")
    got = quantiles.running_totals(df, ["key"], "v", {"n": F.lit(1)}).toPandas().sort_values(["key", "v"])
    want = pdf.groupby(["key", "v"]).size().groupby("key").cumsum().reset_index(name="n").sort_values(["key", "v"])
    assert got["n_to_here"].tolist() == want["n"].tolist()


def test_histogram_edges_and_empty_bins(spark):
    rows = [("a", float(v)) for v in (0, 0, 100, 50)] + [("same", 3.0), ("same", 3.0), ("gone", None)]
    df = spark.createDataFrame(rows, "parameter string, value double")
    got = distribution.histogram(df, ["parameter"], bins=10).toPandas()
    a = got[got.parameter == "a"].sort_values("bin")
    assert a["n"].tolist() == [2, 0, 0, 0, 0, 1, 0, 0, 0, 1]  # the top edge belongs to the last bin
    same = got[got.parameter == "same"].sort_values("bin")
    assert same["n"].sum() == 2 and same["bin_start"].min() == 2.5 and same["bin_end"].max() == 3.5
    assert "gone" not in set(got.parameter)


def readings(spark, days: int, per_day: int = 3, start="2023-01-01"):
    return spark.sql(f"""
        SELECT d * {per_day} + i AS seq, 1L AS location_id, 'pm25' AS parameter, CAST(d * 10 + i AS DOUBLE) AS value,
          TIMESTAMP_NTZ '{start} 00:00:00' + make_interval(0, 0, 0, CAST(d AS INT), CAST(i AS INT)) AS datetime_local,
          TIMESTAMP_NTZ '{start} 00:00:00' + make_interval(0, 0, 0, CAST(d AS INT), CAST(i AS INT)) AS datetime_utc
        FROM range({days}) r(d) CROSS JOIN range({per_day}) s(i)""")


@pytest.mark.parametrize("days, unit", [(61, "Day"), (62, "Week"), (366, "Week"), (367, "Month")])
def test_period_unit_follows_the_span(spark, days, unit):
    units = {r.unit for r in periods.period_calendar(readings(spark, days, 1)).select("unit").distinct().collect()}
    assert units == {unit}


@pytest.mark.parametrize("n, kept", [(29, 29), (30, 30), (31, 31), (59, 59), (60, 30), (61, 31)])
def test_every_nth_keeps_what_the_step_leaves(spark, n, kept):
    got = periods.with_periods(readings(spark, n, 1), 30).select("time_period").distinct().count()
    assert got == kept


def test_box_summary_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(50, 5, 200), [500.0, -400.0]])
    rows = [(i, 1, "pm25", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "seq long, location_id long, parameter string, value double").selectExpr(
        "*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS datetime_local"
    )
    got = distribution.box_summary(df).first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    assert got.q1 == pytest.approx(q1) and got.q3 == pytest.approx(q3)
    assert (got.whisker_low, got.whisker_high, got.outliers) == (inside.min(), inside.max(), len(values) - len(inside))
    assert distribution.box_outliers(df).count() == got.outliers


def test_density_integrates_to_one_and_skips_flat_groups(spark):
    df = readings(spark, 2, 40).unionByName(
        readings(spark, 1, 1, "2023-06-01").withColumn("parameter", F.lit("flat"))
    )
    curve = distribution.violin_density(df).toPandas()
    assert set(curve.parameter) == {"pm25"}
    for _, g in curve.groupby("time_period"):
        g = g.sort_values("x")
        assert len(g) == 100
        assert np.trapezoid(g.density, g.x) == pytest.approx(1, abs=0.06)


def curves_of(spark, groups: dict[str, list]):
    rows = [(p, v) for p, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "parameter string, value double").selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS datetime_local")
    exact = distribution.violin_density(df.where("abs(value) < double('Infinity')")).toPandas()
    return exact, distribution.binned_density(df).toPandas(), df


def test_binned_density_stays_within_its_bound(spark):
    rng = np.random.default_rng(5)
    groups = {
        "even": list(rng.normal(20, 3, 3000)), "tail": [*rng.normal(0, 1, 3000), 1e4], "ties": [1.0] * 900 + [2.0] * 90 + [5.0],
        "two": [1.0, 2.0], "odd": [3.0, 4.0, 4.5, None, float("nan"), float("inf"), -float("inf")], "flat": [7.0] * 5, "one": [1.0], "none": [None],
    }
    exact, binned, _ = curves_of(spark, {p: [None if v is None else float(v) for v in vs] for p, vs in groups.items()})
    both = exact.merge(binned, on=["parameter", "unit", "time_period", "point"], suffixes=("", "_b"))
    assert len(both) == len(exact) == len(binned) == 100 * 5
    assert set(binned.parameter) == {"even", "tail", "ties", "two", "odd"}
    bound = both.bandwidth.map(distribution.binned_density_error)
    assert ((both.density - both.density_b).abs() <= bound).all()
    assert (both.n == both.n_b).all() and np.allclose(both.x, both.x_b)


def test_binned_density_of_an_empty_table(spark):
    df = spark.createDataFrame([], "parameter string, value double, datetime_local timestamp_ntz")
    assert distribution.binned_density(df).count() == 0


@pytest.mark.parametrize("n", [2000, 40_000])
def test_density_bins_do_not_grow_with_the_rows(spark, n):
    """Twenty times the rows narrow the bandwidth by 20 ** 0.2 and widen no range: bins follow that, not the rows."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame(pd.DataFrame({"value": rng.random(n)})).selectExpr("'p' AS parameter", "'day' AS unit", "'d' AS time_period", "value")
    width = float(np.std(rng.random(n)) * n**-0.2)
    grid = spark.createDataFrame([("p", "day", "d", 0, width, 0.0, 0.0, 0.01)], "parameter string, unit string, time_period string, _group long, bandwidth double, _lo double, _start double, _step double")
    bins = distribution.density_bins(rows, grid).toPandas()
    assert len(bins) <= distribution.DENSITY_BINS / width + 1
    assert bins.copies.sum() == n and ((0 <= bins.to_next) & (bins.to_next < bins.copies)).all()


def test_rolling_mean_matches_brute_force(spark):
    df = readings(spark, 4, 9)
    got = {r.datetime_utc: (r.rolling_mean, r.readings) for r in rolling.rolling_mean(df, ["location_id"], hours=24).collect()}
    pdf = df.toPandas()
    for at in pdf.datetime_utc:
        frame = pdf[(pdf.datetime_utc <= at) & (pdf.datetime_utc >= at - pd.Timedelta(hours=24))]
        assert got[at.to_pydatetime()] == (pytest.approx(frame.value.mean()), len(frame))


@pytest.mark.parametrize("size", [0, 1, 7, 60, 500])
def test_random_sample_is_exact_and_repeatable(spark, size):
    df = readings(spark, 20)
    first = {r.seq for r in sampling.random_sample(df, size, seed=5).collect()}
    again = {r.seq for r in sampling.random_sample(df.repartition(3), size, seed=5).collect()}
    assert len(first) == min(size, 60) and first == again
