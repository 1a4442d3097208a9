"""Streaks over a stream of runs: the same whatever the batches, each alert once."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from airloom.plans import runs as plan
from airloom.session import scratch_path
from airloom.streaming import streaks

SCHEMA = "location_id long, run_id string, start_time timestamp_ntz, outcome string"


def logged(n=60, seed=3):
    random.seed(seed)
    return [
        (loc, f"{loc}_{i:03d}", datetime(2024, 1, 1) + timedelta(hours=i // 2), random.choice(["success", "failed", "failed", "exception"]))
        for loc in (1, 2, None) for i in range(n)
    ]


def alerts_of(df):
    return sorted((str(r.timestamp), r.level, r.title, r.message, r.context) for r in df.collect())


def want(spark, rows):
    found = plan.failure_streaks(spark.createDataFrame(rows, SCHEMA), ("location_id",))
    return alerts_of(plan.streak_alerts(found).unionByName(plan.recovery_events(found)))


def run(spark, path, alerts, checkpoint, files=None):
    frame = streaks.read_runs_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files)
    streaks.send_alerts(streaks.streaks_stream(frame, ["location_id"]), alerts, checkpoint).awaitTermination()
    return alerts_of(streaks.sent_alerts(spark, alerts))


def test_batches_restarts_and_repeats(spark):
    rows = sorted(logged(), key=lambda r: (r[2], r[1]))
    path, alerts, checkpoint = (scratch_path(spark, n) for n in ("runs", "alerts", "checkpoint"))
    for a, b in ((0, 31), (31, 80)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert run(spark, path, alerts, checkpoint, files=1) == want(spark, rows[:80])
    # the next load repeats runs that were counted, and the query starts anew
    spark.createDataFrame(rows[60:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert run(spark, path, alerts, checkpoint) == want(spark, rows)
    assert run(spark, path, alerts, checkpoint) == want(spark, rows)


@pytest.mark.parametrize("seed", range(20))
def test_counting_in_parts_equals_counting_at_once(seed):
    rows = pd.DataFrame([r for r in logged(seed=seed) if r[0] == 1], columns=["location_id", "run_id", "start_time", "outcome"])
    whole = streaks.count_on(rows.sample(frac=1, random_state=seed), None, 0)
    random.seed(seed)
    at, last, streak, parts = 0, None, 0, []
    while at < len(rows):
        end = at + random.randint(1, 9)
        part = streaks.count_on(rows.iloc[max(at - 3, 0):end], last, streak)  # with repeats
        parts.append(part)
        if len(part):
            row = part.iloc[-1]
            last, streak = (int(row["start_time"].value // 1000), row["run_id"]), int(row["streak"])
        at = end
    assert pd.concat(parts).reset_index(drop=True).equals(whole.reset_index(drop=True))


def test_equal_start_times_are_ordered_by_run(spark):
    rows = [(1, r, datetime(2024, 1, 1), o) for r, o in (("c", "failed"), ("a", "failed"), ("b", "success"))]
    for order in (rows, rows[::-1]):
        found = {r.run_id: (r.streak, r.recovered) for r in plan.failure_streaks(spark.createDataFrame(order, SCHEMA), ("location_id",)).collect()}
        assert found == {"a": (1, False), "b": (0, True), "c": (1, False)}
