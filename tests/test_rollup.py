"""Rollups kept by ingest beside a full recompute, after crashes, late rows and repeats."""

import pytest
from pyspark.sql import functions as F

from airloom.catalog.base import measurements
from airloom.operators import aggregates
from airloom.plans import ingest as plan
from airloom.sources.rollup import Rollup, merged, partials
from airloom.sources.store import MeasurementStore

SF = "/root/testdata/sf0.001"
NOW = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def rows(spark):
    return measurements(spark, SF).drop("k").cache()


def shown(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def same_as_recomputed(sums):
    stored = sums.store.read()
    stats = ["parameter", "n", "mean", "min", "max", "std"]
    assert shown(sums.parameter_stats().select(stats)) == shown(aggregates.parameter_stats(stored).select(stats))
    assert shown(sums.daily_means().drop("n")) == shown(aggregates.daily_means(stored))
    assert shown(sums.pair_correlations()) == shown(aggregates.pair_correlations(stored))


def load(sums, rows):
    plan.ingest(sums.store, rows, NOW, ["seq"], with_stats=False, rollup=sums)


@pytest.fixture
def sums(spark, rows, folder):
    return Rollup(MeasurementStore(spark, folder, rows.schema))


def test_empty(sums):
    assert sums.parameter_stats().count() == 0 and sums.pair_correlations().count() == 0 and sums.catch_up() == 0


def test_loads_late_rows_and_repeats(sums, rows):
    """The second load brings rows for places and times the first one had."""
    load(sums, rows.where("seq % 3 > 0"))
    same_as_recomputed(sums)
    load(sums, rows)
    same_as_recomputed(sums)
    before = shown(sums.parameter_stats()), shown(sums.pair_correlations())
    load(sums, rows)
    assert before == (shown(sums.parameter_stats()), shown(sums.pair_correlations()))


def test_a_run_that_ended_before_its_aggregates(sums, rows, monkeypatch):
    load(sums, rows.where("seq % 2 = 0"))

    def crash(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(sums, "add", crash)
        with pytest.raises(RuntimeError):
            load(sums, rows)
    assert sums.pending().count() == 1
    load(sums, rows)  # only duplicates, but the crashed run is made up for
    assert sums.pending().count() == 0
    same_as_recomputed(sums)


def test_adding_a_run_twice_changes_nothing(sums, rows):
    load(sums, rows)
    run = sums.daily().first()["ingest_run"]
    sums.add(run, sums.store.partitions_of(run))
    same_as_recomputed(sums)


def test_second_load_reads_its_own_rows_only(sums, rows):
    """Row groups of other runs are left out by their statistics."""
    early = F.col("seq") < 500
    load(sums, rows.where(early))
    first = sums.daily().first()["ingest_run"]
    load(sums, rows.where(~early))
    run = sums.daily().where(F.col("ingest_run") != first).first()["ingest_run"]
    new = sums.store.read().where(F.col("ingest_run") == run)
    df = partials(new)
    df.collect()
    plan_text = df._jdf.queryExecution().executedPlan()
    read = _scanned(plan_text)
    assert read == new.count() < sums.store.read().count()


def _scanned(node):
    """Rows that came out of the file scans of an executed plan."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _scanned(node.executedPlan())
    if node.getClass().getSimpleName().endswith("QueryStageExec"):
        return _scanned(node.plan())
    if "FileSourceScan" in node.getClass().getSimpleName():
        return node.metrics().apply("numOutputRows").value()
    children = node.children()
    return sum(_scanned(children.apply(i)) for i in range(children.size()))


def test_merging_in_any_cut_equals_one_pass(spark, rows):
    whole = shown(merged(partials(rows), ["parameter"]))
    cut = [partials(rows.where(f"seq % 5 = {i}")) for i in range(5)]
    parts = cut[0]
    for p in cut[1:]:
        parts = parts.unionByName(p)
    assert shown(merged(parts, ["parameter"])) == whole


def test_values_that_are_missing_or_alone(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('a', 1L, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(NULL AS DOUBLE)), ('b', 1L, TIMESTAMP_NTZ'2024-01-01 00:00:00', 2.5D)
      AS t(parameter, location_id, datetime_local, value)""")
    assert shown(merged(partials(rows), ["parameter"])) == [("a", 1, None, None, None, None), ("b", 1, 2.5, 2.5, 2.5, None)]
