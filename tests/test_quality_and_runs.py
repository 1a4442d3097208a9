import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom import schema
from airloom.operators import aggregates, drift, filters, joins, pivot, quality
from airloom.plans import report, runs

AS_OF = "2025-12-06 00:00:00"


def rec(**changes):
    base = {
        "value": 25.3, "parameter": {"id": 2, "name": "pm25"},
        "period": {"datetimeFrom": {"utc": "2025-12-05T12:00:00Z"}}, "locationId": 101,
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v != "missing"}


def start(text):
    return rec(period={"datetimeFrom": {"utc": text}})


CASES = [
    (rec(), [], []),
    (rec(value="missing"), ["Missing required field: value"], []),
    (rec(value=None), [], []),
    (rec(locationId=None), [], []),
    (rec(locationId="missing"), ["Missing required field: locationId"], []),
    (rec(parameter="pm25"), ["'parameter' must be a dictionary"], []),
    (rec(parameter={"name": "pm25"}), ["'parameter' must have 'id' and 'name' fields"], []),
    (rec(parameter={"id": None, "name": None}), [], []),
    (rec(parameter="missing"), ["Missing required field: parameter"], []),
    (rec(period={}), ["'period' must have 'datetimeFrom' field"], []),
    (rec(period=7), ["'period' must be a dictionary"], []),
    (rec(period="missing"), ["Missing required field: period"], []),
    (rec(value="high"), [], ["Value is not numeric: high"]),
    (rec(value="12.5"), [], ["Value is not numeric: 12.5"]),
    (rec(value="high", parameter={"id": 9, "name": "um003"}), [], []),
    (rec(value=1000), [], []),
    (rec(value=1001), [], ["pm25 value 1001 outside valid range [0, 1000]"]),
    (rec(value=-0.5), [], ["pm25 value -0.5 outside valid range [0, 1000]"]),
    (rec(value=61.5, parameter={"id": 4, "name": "temperature"}), [], ["temperature value 61.5 outside valid range [-50, 60]"]),
    (start("2025-12-06T00:00:01Z"), ["Timestamp is in the future: 2025-12-06T00:00:01Z"], []),
    (start("2025-12-06T00:00:00Z"), [], []),
    (start("2020-12-07T00:00:00Z"), [], []),  # exactly 1825 days
    (start("2020-12-05T23:00:00Z"), ["Timestamp is older than 5 years: 2020-12-05T23:00:00Z"], []),
    (start("2025-12-05"), [], []),
    (start("2025"), ["Invalid timestamp format: 2025"], []),
    (start("yesterday"), ["Invalid timestamp format: yesterday"], []),
    (start(""), [], []),
    (start("2025-12-06T01:00:00+05:45"), [], []),
    (rec(value="missing", period={}), ["Missing required field: value", "'period' must have 'datetimeFrom' field"], []),
]


def validated(spark, records, **options):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "seq long, t string")
    rules = quality.range_rules(spark, **options)
    return quality.validate(df.select("seq", F.try_parse_json("t").alias("record")), rules, AS_OF)


def test_every_rule(spark):
    got = validated(spark, [c[0] for c in CASES]).orderBy("seq").collect()
    for row, (source, errors, warnings) in zip(got, CASES):
        assert (row.errors, row.warnings, row.valid) == (errors, warnings, not errors), source


def test_metrics_limits_and_report(spark):
    rows = validated(spark, [c[0] for c in CASES])
    m = quality.quality_metrics(rows).first()
    bad = sum(1 for c in CASES if c[1])
    assert (m.total_records, m.invalid_records, m.warnings) == (len(CASES), bad, sum(len(c[2]) for c in CASES))
    assert m.quality_score == pytest.approx((len(CASES) - bad) / len(CASES) * 100)
    errors = quality.first_errors(rows)
    assert [r.seq for r in errors.collect()] == [i for i, c in enumerate(CASES) if c[1]][:10]
    assert quality.first_results(rows).count() == 5
    lines = [r.text for r in report.validation_report(quality.quality_metrics(rows), errors, AS_OF).orderBy("line_no").collect()]
    assert lines[5] == f"Total Records: {len(CASES)}" and "VALIDATION ERRORS:" in lines and lines[-1] == "=" * 60


def test_no_records_means_no_score(spark):
    metrics = quality.quality_metrics(validated(spark, [rec()]).where("false"))
    assert metrics.first().quality_score is None and quality.below_gate(metrics).count() == 0


def test_rule_aliases(spark):
    wet = rec(value=120, parameter={"id": 5, "name": "relativehumidity"})
    assert validated(spark, [wet]).first().warnings == []
    assert validated(spark, [wet], aliases={"relativehumidity": "humidity"}).first().warnings != []


def run_rows(spark, outcomes):
    at = datetime(2025, 1, 1)
    return spark.createDataFrame(
        [(f"r{i:04d}", at + timedelta(hours=2 * i), o) for i, o in enumerate(outcomes)], "run_id string, start_time timestamp_ntz, outcome string"
    )


def test_streaks_alerts_and_recovery(spark):
    outcomes = ["failed", "failed", "success", "failed", "failed", "failed", "exception", "success", "success"]
    streaks = runs.failure_streaks(run_rows(spark, outcomes))
    rows = streaks.orderBy("start_time").collect()
    assert [r.streak for r in rows] == [1, 2, 0, 1, 2, 3, 4, 0, 0]
    assert [r.recovered for r in rows] == [False, False, True, False, False, False, False, True, False]
    alerts = runs.streak_alerts(streaks).orderBy("timestamp").collect()
    assert [(a.level, a.title) for a in alerts] == [
        ("error", "Pipeline Consecutive Failures"), ("critical", "Pipeline Critical Failure"),
    ]
    assert runs.recovery_events(streaks).count() == 2


def test_only_the_last_hundred_runs_stay(spark):
    kept = runs.last_runs(run_rows(spark, ["success"] * 130)).collect()
    assert len(kept) == 100 and kept[0].run_id == "r0129"


def test_alert_channels_and_master_switch(spark):
    alerts = spark.createDataFrame([("warning",)], "level string")
    assert runs.with_channels(alerts, False, {"slack": True}).count() == 0
    assert runs.with_channels(alerts, True, {"slack": True, "email": False}).first().channels == ["slack"]
    assert runs.with_channels(alerts, True).first().channels == []


def test_run_metrics_default_to_zero(spark):
    at = datetime(2025, 1, 1)
    row = ("r", at, at + timedelta(seconds=90), {"failed_locations": 2.0}, [("t", "boom", {"a": "b"})])
    got = runs.run_metrics(spark.createDataFrame([row], schema.RUN)).first()
    assert (got.failed_locations, got.total_records_fetched, got.total_errors, got.elapsed_seconds) == (2.0, 0.0, 1, 90.0)
    assert runs.slow_responses(spark.createDataFrame([row], schema.RUN)).count() == 0


def flat(spark, rows):
    return spark.createDataFrame(rows, "seq long, location_id long, parameter string, value double, units string, h int").selectExpr(
        "*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) AS datetime_utc",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h, 345) AS datetime_local",
    )


def test_pivot_first_skips_nulls_and_follows_arrival(spark):
    df = flat(spark, [(1, 1, "pm25", None, "u", 0), (3, 1, "pm25", 30.0, "u", 0), (2, 1, "pm25", 20.0, "u", 0), (4, 1, "pm1", None, "u", 1)])
    rows = pivot.pivot_first(df, ["pm25", "pm1"]).collect()
    assert [(r.pm25, r.pm1) for r in rows] == [(20.0, None)]


def test_aqi_uses_ozone_in_ppm_only(spark):
    df = flat(spark, [(1, 1, "o3", 0.06, "ppm", 0), (2, 1, "o3", 60.0, "µg/m³", 1), (3, 1, "pm25", 5.0, "µg/m³", 1)])
    rows = {r.datetime_utc.hour: r for r in pivot.aqi_records(df).collect()}
    assert (rows[0].aqi_o3, rows[0].aqi_overall) == (67, 67)
    assert (rows[1].aqi_o3, rows[1].aqi_overall, rows[1].o3) == (None, 21, 60.0)


def test_one_row_has_no_deviation_or_correlation(spark):
    df = flat(spark, [(1, 1, "pm25", 5.0, "u", 0), (2, 1, "pm1", 6.0, "u", 0)])
    assert aggregates.parameter_stats(df).where("parameter = 'pm25'").first().std is None
    pairs = aggregates.pair_correlations(df).collect()
    assert [(p.parameter_x, p.parameter_y, p.correlation, p.samples) for p in pairs] == [("pm25", "pm1", None, 1)]


def test_counts_agree_across_views(spark):
    df = flat(spark, [(i, i % 3, ["pm25", "pm1"][i % 2], float(i), "u", i % 5) for i in range(50)])
    total = aggregates.overview(df).first().records
    assert total == 50
    assert total == aggregates.parameter_stats(df).agg(F.sum("n")).first()[0]
    assert total == aggregates.location_profile(df).agg(F.sum("records")).first()[0]
    share = aggregates.category_share(pivot.aqi_records(df)).agg(F.sum("share")).first()[0]
    assert share == pytest.approx(100)


def test_empty_input_gives_empty_or_zero(spark):
    df = flat(spark, [(1, 1, "pm25", 5.0, "u", 0)]).where("false")
    assert aggregates.overview(df).first().records == 0
    assert aggregates.parameter_stats(df).count() == 0
    assert aggregates.pair_correlations(df).count() == 0
    assert aggregates.period_aqi(pivot.aqi_records(df)).count() == 0


def test_deny_list_and_names(spark):
    df = flat(spark, [(1, 3459, "pm25", 5.0, "u", 0), (2, 6093549, "pm25", 5.0, "u", 0), (3, 8, "pm25", 5.0, "u", 0)])
    assert filters.removal_count(df).first() == (3, 2, 1)
    names = spark.createDataFrame([(6093549, "Golfutar")], "location_id long, location_name string")
    named = joins.with_location_name(filters.without_locations(df), names)
    assert {r.location_name for r in named.collect()} == {"Golfutar", "Location 8"}


def test_drift_of_equal_and_shifted_samples(spark):
    rows = [(i, 1, "same", float(i % 40), "u", 0) for i in range(400)] + [(i, 1, "moved", float(i % 40 + (100 if i >= 200 else 0)), "u", 0) for i in range(400)]
    df = flat(spark, rows)
    ks = {r.parameter: r.ks for r in drift.ks_statistic(df, F.col("seq") >= 200).collect()}
    psi = {r.parameter: r.psi for r in drift.population_stability(df, F.col("seq") >= 200).collect()}
    assert ks == {"same": pytest.approx(0), "moved": pytest.approx(1)}
    assert psi["same"] == pytest.approx(0) and psi["moved"] > 1
