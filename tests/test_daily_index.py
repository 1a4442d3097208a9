"""The daily index as a stream: closed days equal the batch index, restarts add nothing."""

import pytest
from pyspark.sql import functions as F

from airloom.catalog.base import PARAMETERS, measurements
from airloom.operators.aggregates import daily_aqi
from airloom.operators.pivot import aqi_records
from airloom.session import scratch_path
from airloom.sources.store import MeasurementStore
from airloom.streaming.daily import write_closed_days
from airloom.streaming.daily_index import daily_index_stream, open_day_indices

SF = "/root/testdata/sf0.001"


@pytest.fixture
def setup(spark):
    m = measurements(spark, SF).drop("k")
    return m, MeasurementStore(spark, scratch_path(spark, "store"), m.schema), scratch_path(spark, "days"), scratch_path(spark, "checkpoint")


def run(spark, kept, path, checkpoint):
    days = daily_index_stream(kept.read_stream(files_per_batch=7), parameters=PARAMETERS)
    query = write_closed_days(days, path, checkpoint)
    query.awaitTermination()
    return spark.read.schema(days.schema).parquet(path), query


def shown(df):
    return sorted((r.location_id, str(r.date), None if r.aqi is None else round(r.aqi, 9)) for r in df.collect())


def test_closed_days_equal_the_batch_index(spark, setup):
    m, kept, path, checkpoint = setup
    early = F.col("datetime_utc") < F.lit("2024-01-10").cast("timestamp_ntz")
    kept.append(m.where(early))
    closed, _ = run(spark, kept, path, checkpoint)
    first = shown(closed)
    assert first
    kept.append(m.where(~early))
    closed, query = run(spark, kept, path, checkpoint)
    both = shown(closed)
    assert set(first) < set(both)
    whole = shown(daily_aqi(aqi_records(m, PARAMETERS)))
    assert set(both) < set(whole)
    assert sorted(both + shown(open_day_indices(kept.read(), closed, PARAMETERS))) == whole
    closed, _ = run(spark, kept, path, checkpoint)  # nothing new landed
    assert shown(closed) == both
    # state: open hours and open days only
    held = [op["numRowsTotal"] for op in query.lastProgress["stateOperators"]]
    assert len(held) == 2 and all(n < 24 * 3 * 10 for n in held)


def test_a_reading_for_a_closed_day_changes_nothing(spark, setup):
    m, kept, path, checkpoint = setup
    kept.append(m)
    before = shown(run(spark, kept, path, checkpoint)[0])
    late = m.where("parameter = 'pm25'").orderBy("datetime_utc").limit(1).withColumn("value", F.lit(499.0)).withColumn("seq", F.lit(-1).cast("long"))
    kept.append(late)
    assert shown(run(spark, kept, path, checkpoint)[0]) == before


def test_first_value_of_an_hour_counts(spark, setup):
    _, _, path, checkpoint = setup
    rows = spark.sql("""SELECT * FROM VALUES
      (2L, 1L, 'pm25', 100.0D, 'µg/m³', '2024-01-01 05:00:00'), (1L, 1L, 'pm25', 10.0D, 'µg/m³', '2024-01-01 05:00:00'),
      (3L, 1L, 'o3', 0.06D, 'ppb', '2024-01-01 05:00:00'), (4L, 1L, 'pm25', CAST(NULL AS DOUBLE), 'µg/m³', '2024-01-01 06:00:00'),
      (5L, 1L, 'pm25', 20.0D, 'µg/m³', '2024-01-09 05:00:00') AS t(seq, location_id, parameter, value, units, at)""")
    rows = rows.select("seq", "location_id", "parameter", "value", "units", F.col("at").cast("timestamp_ntz").alias("datetime_utc"), F.col("at").cast("timestamp_ntz").alias("datetime_local"))
    kept = MeasurementStore(spark, scratch_path(spark, "store"), rows.schema)
    kept.append(rows)
    assert shown(run(spark, kept, path, checkpoint)[0]) == [(1, "2024-01-01", 42.0)]
