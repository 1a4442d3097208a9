import json
import os

import pytest
from pyspark.sql import functions as F

from airloom import schema
from airloom.operators import dedup
from airloom.plans import ingest, merge, runs
from airloom.sources import landed, store
from airloom.streaming import ingest as streaming
from airloom.streaming.ingest import backlog_share, stream_ingest, stream_records


def record(value=25.3, pid=2, name="pm25", hour=12, place=101, sensor=9001, **extra):
    out = {
        "value": value,
        "parameter": {"id": pid, "name": name, "units": "µg/m³"},
        "period": {
            "interval": "01:00:00",
            "datetimeFrom": {"utc": f"2025-12-05T{hour:02d}:00:00Z", "local": f"2025-12-05T{hour + 5:02d}:45:00+05:45"},
            "datetimeTo": {"utc": f"2025-12-05T{hour + 1:02d}:00:00Z"},
        },
        "locationId": place, "sensors": [{"id": sensor, "name": "s"}],
    }
    out.update(extra)
    return {k: v for k, v in out.items() if v != "missing"}


def write(folder: str, name: str, content) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content, indent=2))
    return path


def load(spark, folder):
    return landed.parse_documents(landed.read_documents(spark, f"{folder}/location_*.json"))


def test_pretty_printed_arrays_and_bad_neighbours(spark, folder):
    write(folder, "location_101.json", [record(), record(hour=13)])
    write(folder, "location_102.json", "{not json")
    write(folder, "location_103.json", {"results": []})
    write(folder, "location_104.json", [record(place=104), "text", record(place=104, parameter={"id": 1}), record(place=104, hour=14)])
    write(folder, "location_105.json", [record(place=999)])
    write(folder, "location_106.json", [record(place="missing")])
    parsed = load(spark, folder)
    reasons = {os.path.basename(r.source_file): r.reject_reason for r in landed.quarantined_documents(parsed).collect()}
    assert reasons == {"location_102.json": landed.NOT_JSON, "location_103.json": landed.NOT_ARRAY}
    typed = landed.typed_records(landed.explode_records(parsed))
    assert sorted(r.location_id for r in landed.accepted(typed).collect()) == [101, 101, 104, 104, 106]
    assert sorted(r.reject_reason for r in landed.rejected(typed).collect()) == [
        "location differs from file name", "no parameter name", "record is not an object",
    ]


def test_plain_text_parameter_with_the_adapter(spark, folder):
    write(folder, "location_1.json", [{**record(place=1), "parameter": "pm25", "sensorId": 1, "sensors": []}])
    records = landed.explode_records(load(spark, folder))
    assert landed.rejected(landed.typed_records(records)).count() == 1
    row = landed.accepted(landed.typed_records(records, adapt_plain_parameter=True)).first()
    assert (row.parameter, row.sensor_id) == ("pm25", 1)


def test_clean_reader_equals_tolerant_reader(spark, folder):
    write(folder, "location_101.json", [record(), record(pid=1, name="pm1", hour=3, sensors=[])])
    cols = ["location_id", "parameter_id", "parameter", "value", "datetime_utc", "datetime_local", "utc_offset", "sensor_id"]
    clean = landed.read_clean_arrays(spark, folder).select(*cols).collect()
    tolerant = landed.accepted(landed.typed_records(landed.explode_records(load(spark, folder)))).select(*cols).collect()
    assert sorted(map(str, clean)) == sorted(map(str, tolerant))


def test_directory_skips_sensors_without_id(spark, folder):
    page = {"results": [{"id": 5, "name": "x", "sensors": [
        {"id": 1, "parameter": {"name": "pm25"}}, {"id": 0, "parameter": {"name": "pm1"}}, {"parameter": {"name": "o3"}}, {"id": 2, "parameter": {}},
    ]}, {"id": 6, "name": "other", "sensors": [{"id": 9}]}]}
    write(folder, "directory.json", json.dumps(page))
    rows = landed.read_directory(spark, folder).collect()
    assert sorted((r.location_id, r.sensor_id, r.parameter) for r in rows) == [(5, 1, "pm25"), (5, 2, "unknown")]


KEYED = "seq long, location_id long, parameter_id long, sensor_id long, datetime_utc string, datetime_to_utc string"


def test_dedup_counts_missing_key_parts_as_equal(spark):
    rows = [(1, 1, 2, None, "a", "b"), (2, 1, 2, None, "a", "b"), (3, None, 2, None, "a", "b"), (4, 1, 3, None, "a", "b")]
    df = spark.createDataFrame(rows, KEYED)
    kept = dedup.keep_first(df, schema.INGEST_KEY, ["seq"])
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 4]
    assert dedup.not_in(df, df.where("seq = 1"), schema.INGEST_KEY).count() == 2


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id AS seq", "id % 3 AS k")
    plan = dedup.keep_first(df, ["k"], ["seq"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_merge_prefers_the_first_source_and_is_idempotent(spark):
    a = spark.createDataFrame([(5, 1, 2, 7, "t1", "x")], KEYED)
    b = spark.createDataFrame([(1, 1, 2, 7, "t1", "x"), (2, 1, 3, 7, "t1", "x")], KEYED)
    once = merge.merge([a, b])
    assert sorted(r.seq for r in once.collect()) == [2, 5]
    assert sorted(r.seq for r in merge.merge([once, once]).collect()) == [2, 5]


def flat_rows(spark, hours, value=1.0, place=1, parameter="pm25"):
    rows = [(h, place, 2, parameter, value, f"2025-12-05 {h:02d}:00:00", f"2025-12-05 {h + 1:02d}:00:00", 7) for h in hours]
    return spark.createDataFrame(
        rows, "seq long, location_id long, parameter_id long, parameter string, value double, f string, t string, sensor_id long"
    ).selectExpr(
        "seq", "location_id", "parameter_id", "parameter", "value", "CAST(f AS TIMESTAMP_NTZ) AS datetime_utc",
        "CAST(f AS TIMESTAMP_NTZ) AS datetime_local", "CAST(t AS TIMESTAMP_NTZ) AS datetime_to_utc", "sensor_id",
    )


def stats_of(frame):
    return {r.location_id: (r.fetched_records, r.new_records, r.duplicates_removed, r.total_records, r.status) for r in frame.collect()}


def test_ingest_twice_adds_nothing_and_keeps_the_bookmark(spark, folder):
    rows = flat_rows(spark, [1, 2, 2, 3])
    kept = store.MeasurementStore(spark, folder, rows.schema)
    assert stats_of(ingest.ingest(kept, rows, "2025-12-06 00:00:00", ["seq"])) == {1: (4, 3, 1, 3, "success")}
    assert stats_of(ingest.ingest(kept, rows, "2025-12-07 00:00:00", ["seq"])) == {1: (4, 0, 4, 3, "success")}
    assert kept.read().count() == 3
    state = kept.read_state().collect()
    assert [(r.parameter, r.last_fetch_time.hour, r.last_records_count) for r in state] == [("pm25", 4, 0)]


def test_bookmark_never_moves_back_and_reset_loads_all(spark, folder):
    rows = flat_rows(spark, [5, 6])
    kept = store.MeasurementStore(spark, folder, rows.schema)
    ingest.ingest(kept, rows, "2025-12-06 00:00:00", ["seq"])
    late = flat_rows(spark, [2])
    ingest.ingest(kept, late, "2025-12-06 02:00:00", ["seq"])
    assert kept.read_state().first().last_fetch_time.hour == 7
    everything = flat_rows(spark, [1, 2, 5, 6, 9])
    assert sorted(r.seq for r in ingest.since_bookmark(everything, kept.read_state()).collect()) == [9]
    assert sorted(r.seq for r in ingest.since_bookmark(everything, kept.read_state(), "2 hours").collect()) == [5, 6, 9]
    kept.reset_state()
    assert ingest.since_bookmark(everything, kept.read_state()).count() == 5


def test_a_location_with_only_rejected_rows_fails_alone(spark):
    good, empty = flat_rows(spark, [1]), flat_rows(spark, [1]).where("false")
    rejected = spark.createDataFrame([(2,)], "location_id long")
    got = stats_of(ingest.location_stats(good, good, empty, rejected))
    assert got[1][-1] == "success" and got[2] == (0, 0, 0, 0, "error")
    summary = ingest.run_summary(ingest.location_stats(good, good, empty, rejected)).first()
    assert (summary.total_locations, summary.successful, summary.failed, summary.total_new_records) == (2, 1, 1, 1)


def test_overwrite_touches_only_its_partitions(spark, folder):
    rows = flat_rows(spark, [1, 2]).unionByName(flat_rows(spark, [1, 2], place=2))
    kept = store.MeasurementStore(spark, folder, rows.schema)
    kept.append(rows)
    kept.overwrite(flat_rows(spark, [9]))
    got = {r.location_id: r["count"] for r in kept.read().groupBy("location_id").count().collect()}
    assert got == {1: 1, 2: 2}
    plan = kept.location(2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(location_id" in plan


def test_time_filter_prunes_months_and_reaches_the_files(spark, folder):
    rows = flat_rows(spark, [1, 2, 3])
    old = rows.withColumn("datetime_utc", F.expr("datetime_utc - INTERVAL 1 YEAR"))
    kept = store.MeasurementStore(spark, folder, rows.schema)
    kept.append(rows.unionByName(old))
    recent = kept.since("2025-12-05 02:00:00", 1).select("value")
    assert recent.count() == 2
    scan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(datetime_utc" in scan and "event_month" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert scan.split("ReadSchema: ")[1].startswith("struct<value:double,datetime_utc:timestamp_ntz>")


def test_versions_keep_the_previous_one(spark, folder):
    first = flat_rows(spark, [1, 2])
    assert store.latest_version(spark, folder) is None
    assert store.write_version(first, folder) == 1
    assert merge.save_merged(first.where("seq = 1"), folder) == 2
    assert store.current_version(spark, folder, first.schema).count() == 1
    assert store.current_version(spark, folder, first.schema, back=1).count() == 2
    assert store.current_version(spark, folder, first.schema, back=2).count() == 0


def test_history_is_pruned_to_the_batch(spark, folder):
    old = flat_rows(spark, [1]).withColumn("datetime_utc", F.expr("datetime_utc - INTERVAL 2 YEARS"))
    timeless = flat_rows(spark, [1]).withColumn("datetime_utc", F.expr("CAST(NULL AS TIMESTAMP_NTZ)"))
    kept = store.MeasurementStore(spark, folder, old.schema)
    kept.append(old.unionByName(flat_rows(spark, [2])).unionByName(timeless))
    # rows without a time lie apart and are always looked at
    touched = ingest.touched_history(kept.read(), ingest.touched_by(flat_rows(spark, [3])))
    assert sorted(str(r.datetime_utc) for r in touched.collect()) == ["2025-12-05 02:00:00", "None"]
    plan = touched._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "dynamicpruning" in plan and "event_month" in filters and "subquery" in filters.lower()
    alone = ingest.touched_history(kept.read(), ingest.touched_by(timeless))
    assert [r.datetime_utc for r in alone.collect()] == [None]


def test_totals_are_counted_in_the_locations_of_the_batch_only(spark, folder):
    rows = flat_rows(spark, [1, 2]).unionByName(flat_rows(spark, [1], place=2)).unionByName(flat_rows(spark, [1], place=None))
    kept = store.MeasurementStore(spark, folder, rows.schema)
    ingest.ingest(kept, rows, "2025-12-06 00:00:00", ["seq"])
    configured = spark.createDataFrame([(1,), (9,)], "location_id long")
    got = stats_of(ingest.ingest(kept, flat_rows(spark, [3]).unionByName(flat_rows(spark, [4], place=None)), "2025-12-07 00:00:00", ["seq"], configured=configured))
    assert got == {1: (1, 1, 0, 3, "success"), 9: (0, 0, 0, 0, "success"), None: (1, 1, 0, 2, "success")}
    listed = spark.createDataFrame([(1, 1)], "location_id long, n long")
    assert "dynamicpruning" in ingest.records_of(kept.read(), listed)._jdf.queryExecution().executedPlan().toString()


def test_an_ingest_leaves_its_row_in_the_run_log(spark, folder):
    rows = flat_rows(spark, [1, 2, 2])
    kept = store.MeasurementStore(spark, folder, rows.schema)
    stats = ingest.ingest(kept, rows, "2025-12-06 00:00:00", ["seq"])
    kept.append_run(runs.run_row(stats, "r1", "2025-12-06 00:00:00", "2025-12-06 00:00:30"))
    row = runs.run_metrics(kept.read_runs()).first()
    assert (row.total_records_fetched, row.total_records_deduplicated, row.total_locations_processed) == (3, 1, 1)
    assert (row.successful_locations, row.failed_locations, row.duration_seconds, row.total_errors) == (1, 0, 30, 0)


def test_the_first_line_of_a_stream_stays(spark, folder):
    write(folder, "a.json", "\n".join(json.dumps(record(value=v)) for v in (5.0, 1.0, 9.0)))
    records = stream_records(spark, folder)
    kept = store.MeasurementStore(spark, f"{folder}_store", records.schema)
    stream_ingest(records, kept, f"{folder}_checkpoint").awaitTermination()
    assert [r.value for r in kept.read().collect()] == [5.0]


def test_a_stream_with_a_cadence_runs_on_until_it_is_stopped(spark, folder):
    write(folder, "a.json", json.dumps(record()))
    records = stream_records(spark, folder)
    kept = store.MeasurementStore(spark, f"{folder}_store", records.schema)
    running = stream_ingest(records, kept, f"{folder}_checkpoint", every="1 second")
    try:
        running.processAllAvailable()
        write(folder, "b.json", json.dumps(record(hour=13)))
        running.processAllAvailable()
        assert running.isActive and kept.read().count() == 2
    finally:
        running.stop()


def test_an_array_longer_than_one_variant_is_read_whole(spark, folder):
    one = json.dumps({**record(place=1), "note": "x" * 4000})
    n = 128 * 2**20 // len(one) + 100
    write(folder, "location_1.json", "[" + ",".join([one] * n) + "]")
    write(folder, "location_2.json", "[" + ",".join([one] * n) + ",")
    parsed = load(spark, folder)
    assert landed.explode_records(parsed).count() == n
    assert [r.reject_reason for r in landed.quarantined_documents(parsed).select("reject_reason").collect()] == [landed.TOO_LONG]


def test_numbers_of_two_files_never_mix(spark):
    places = [(f"location_{i}.json", p) for i in range(3) for p in (0, 2**24, 2**31 - 1)]
    rows = landed.with_arrival_order(spark.createDataFrame(places, "source_file string, position int")).orderBy("seq").collect()
    files = [r.source_file for r in rows]
    assert len({r.seq for r in rows}) == 9 and files == sorted(files, key=files.index)
    assert all(r.seq >= 0 for r in rows) and [r.position for r in rows] == [0, 2**24, 2**31 - 1] * 3


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_stream_equals_batch_and_replay_is_harmless(spark, folder, files_per_batch):
    for i in range(3):
        rows = [record(value=float(i), hour=h) for h in range(i, i + 4)] + [record(pid=1, name="pm1", hour=i)]
        write(folder, f"page{i}.json", "\n".join(json.dumps(r) for r in rows))
    records = stream_records(spark, folder, files_per_batch)
    kept = store.MeasurementStore(spark, f"{folder}_store", records.schema)
    for attempt in ("a", "b"):  # the second checkpoint replays every file
        stream_ingest(records, kept, f"{folder}_checkpoint_{attempt}").awaitTermination()
    key = ["parameter_id", "datetime_utc"]
    got = sorted((r.parameter_id, r.datetime_utc) for r in kept.read().select(*key).collect())
    batch = spark.read.schema(schema.RAW_RECORD).json(folder)
    flat = batch.select(*landed.flat(F.struct(*batch.columns)))
    want = sorted((r.parameter_id, r.datetime_utc) for r in flat.select(*key).distinct().collect())
    assert got == want and len(got) == 9


def test_a_backlog_makes_a_bounded_number_of_batches(spark, folder, monkeypatch):
    monkeypatch.setattr(streaming, "BACKLOG_BATCHES", 3)
    for i in range(8):
        write(folder, f"page{i}.json", "\n".join(json.dumps(record(hour=h)) for h in (i, i + 1)))
    assert [backlog_share(spark, folder, n) for n in (1, 3, 5)] == [3, 3, 5]
    records = stream_records(spark, folder, backlog_share(spark, folder, 1))
    kept = store.MeasurementStore(spark, f"{folder}_store", records.schema)
    stream_ingest(records, kept, f"{folder}_checkpoint").awaitTermination()
    assert kept.read().count() == 9
    assert store.latest_version(spark, f"{kept.root}/state") == 3  # one a batch


def test_overwrite_replaces_all_months_of_its_locations(spark, folder):
    rows = flat_rows(spark, [1, 2]).unionByName(flat_rows(spark, [1, 2], place=2))
    old = rows.withColumn("datetime_utc", F.expr("datetime_utc - INTERVAL 2 YEARS"))
    timeless = flat_rows(spark, [1]).withColumn("datetime_utc", F.expr("CAST(NULL AS TIMESTAMP_NTZ)"))
    kept = store.MeasurementStore(spark, folder, rows.schema)
    kept.append(rows.unionByName(old).unionByName(timeless))
    kept.overwrite(flat_rows(spark, [9]))
    months = {(r.location_id, r.event_month): r["count"] for r in kept.read().groupBy("location_id", "event_month").count().collect()}
    assert months == {(1, "2025-12"): 1, (2, "2025-12"): 2, (2, "2023-12"): 2}
    kept.overwrite(kept.location(2).where("event_month = '2023-12'"))  # read from the store that is written
    assert {(r.location_id, r.event_month) for r in kept.read().collect()} == {(1, "2025-12"), (2, "2023-12")}


def test_malformed_lines_of_a_stream_go_to_quarantine(spark, folder):
    good = json.dumps(record())
    write(folder, "page.json", "\n".join([good, good[:60], json.dumps(record(place=7, parameter={"id": 1})), json.dumps(record(hour=13))]))
    records = stream_records(spark, folder)
    kept = store.MeasurementStore(spark, f"{folder}_store", records.schema)
    stream_ingest(records, kept, f"{folder}_checkpoint").awaitTermination()
    assert [r.location_id for r in kept.read().collect()] == [101, 101]
    bad = {(r.reject_reason, r.location_id) for r in kept.read_quarantine().collect()}
    assert bad == {("line is not a record", None), ("no parameter name", 7)}


def test_a_location_with_only_bad_records_is_an_error(spark, folder):
    good = flat_rows(spark, [1]).withColumns({"reject_reason": F.lit(None).cast("string"), "raw": F.lit("{}")})
    bad = flat_rows(spark, [1], place=7).withColumns({"reject_reason": F.lit("no start time"), "raw": F.lit("{}")})
    kept = store.MeasurementStore(spark, folder, good.schema)
    stats = ingest.ingest(kept, good.unionByName(bad), "2025-12-06 00:00:00", ["seq"])
    assert {(r.location_id, r.status, r.total_records) for r in stats.collect()} == {(1, "success", 1), (7, "error", 0)}
    assert kept.read().count() == 1 and kept.read_quarantine().count() == 1


def test_broken_pages_are_named(spark, folder):
    write(folder, "pages.json", "\n".join([json.dumps({"results": [record()]}), '{"results": [', '{"results": 3}']))
    assert landed.read_pages(spark, folder).count() == 1
    assert {r.reject_reason for r in landed.quarantined_pages(spark, folder).collect()} == {landed.NOT_ARRAY, landed.NOT_JSON}
