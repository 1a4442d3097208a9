import datetime

import numpy as np
import pytest

from airloom.operators import drift

START = datetime.date(2024, 1, 1)


def frame(spark, series: dict[int, list]):
    rows = [(k, START + datetime.timedelta(days=i), 0.0, None if e is None else float(e)) for k, es in series.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "location_id long, date date, prediction double, actual double")


def by_loop(errors: list, slack: float, threshold: float) -> list[tuple]:
    """The statistic as a recursion that is held at 0, with one alarm between two zeros."""
    out, total, n, excess, since, told = [], 0.0, 0, 0.0, None, False
    for i, e in enumerate(errors):
        if e is not None:
            total, n = total + e, n + 1
            excess = max(0.0, excess + e - (1 + slack) * total / n)
        if excess < 1e-9:
            since, told = i, False
        changed = e is not None and excess > threshold * total / n
        out.append((round(excess, 6), changed, since, changed and not told))
        told = told or changed
    return out


def found(spark, series, **options):
    rows = drift.error_changes(frame(spark, series), **options).orderBy("location_id", "date").collect()
    out = {k: [] for k in series}
    for r in rows:
        out[r.location_id].append((round(r.excess, 6), r.changed, None if r.since is None else (r.since - START).days, r.alarm))
    return out


@pytest.mark.parametrize("slack, threshold", [(0.1, 1.5), (0.03, 4.0)])
def test_equals_the_recursion(spark, slack, threshold):
    rng = np.random.default_rng(8)
    series = {k: [float(v) for v in rng.gamma(2, 1 + k, 80)] for k in range(6)}
    series[6] = [None if i % 5 == 2 else e for i, e in enumerate(series[0])]
    got = found(spark, series, slack=slack, threshold=threshold)
    assert got == {k: by_loop(es, slack, threshold) for k, es in series.items()}
    assert any(alarm for rows in got.values() for *_, alarm in rows)


def test_one_alarm_a_change_and_a_reset_between(spark):
    calm, high = [1.0] * 40, [3.0] * 6
    rows = found(spark, {1: calm + high + [0.2] * 40 + high, 2: calm})
    alarms = [i for i, r in enumerate(rows[1]) if r[3]]
    assert len(alarms) == 2 and 40 <= alarms[0] <= 42 and 86 <= alarms[1] <= 88
    assert rows[1][alarms[0]][2] == 39 and 84 <= rows[1][alarms[1]][2] <= 85
    assert not any(changed for _, changed, *_ in rows[2])


def test_days_without_errors_and_an_empty_table(spark):
    rows = found(spark, {1: [None, None, 1.0, None]})[1]
    assert [r[1] for r in rows] == [False] * 4 and rows[0][0] == 0
    assert drift.error_changes(frame(spark, {})).count() == 0


def test_one_exchange(spark):
    plan = drift.error_changes(frame(spark, {1: [1.0]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
