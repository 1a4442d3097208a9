"""Source and sink queries: readings are landed as files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom import schema
from airloom.catalog import base
from airloom.catalog.alerts import R, run_log
from airloom.catalog.base import M, OM, query
from airloom.catalog.charts import summary_report as report_query
from airloom.catalog.ingest import RUN_TIME
from airloom.catalog.rows import nested_record
from airloom.catalog.statistics import CORRELATIONS, WIDE
from airloom.plans import ingest as plan
from airloom.plans import merge
from airloom.session import scratch_path
from airloom.sources import landed, ranges, store
from airloom.sources.rollup import Rollup

FLAT = ["location_id", "parameter_id", "parameter", "units", "value", "datetime_utc", "datetime_local", "datetime_to_utc", "sensor_id"]
FLAT_SQL = """location_id, parameter_id, parameter, units, round(value + 1e-9, 6) AS value, datetime_utc::VARCHAR AS datetime_utc,
  datetime_local::VARCHAR AS datetime_local, datetime_to_utc::VARCHAR AS datetime_to_utc, sensor_id"""
PAGE_RECORDS = 5000


def document_pages(m: DataFrame) -> DataFrame:
    """(location_id, page, list of record texts), at most 5,000 records a page."""
    page = F.floor(F.col("seq") / PAGE_RECORDS).alias("page")
    entry = F.struct("seq", F.to_json(nested_record(m)).alias("json"))
    pages = m.groupBy("location_id", page).agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    return pages.select("location_id", "page", F.col("_list.json").alias("records"))


def land_arrays(spark, sf_dir, text=None) -> str:
    """One JSON array per file under a folder per location."""
    path = scratch_path(spark, "arrays")
    pages = document_pages(base.measurements(spark, sf_dir))
    array = F.concat(F.lit("["), F.array_join("records", ","), F.lit("]"))
    pages.select("location_id", (array if text is None else text(array)).alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).partitionBy("location_id").text(path)
    return path


@query("landed_arrays", "SRC-1 SRC-3 SET-1 SCL-S5", f"WITH {M} SELECT {FLAT_SQL} FROM m")
def landed_arrays(spark, sf_dir):
    documents = landed.read_documents(spark, land_arrays(spark, sf_dir))
    records = landed.explode_records(landed.parse_documents(documents))
    return landed.accepted(landed.typed_records(records)).select(*FLAT)


@query("landed_arrays_by_ranges", "SRC-1 SRC-6", f"WITH {M} SELECT {FLAT_SQL} FROM m")
def landed_arrays_by_ranges(spark, sf_dir):
    """The same files, each read by as many tasks as it has byte ranges."""
    records = ranges.parse_records(ranges.array_records(spark, land_arrays(spark, sf_dir))).drop("text")
    return landed.accepted(landed.typed_records(records)).select(*FLAT)


@query("landed_arrays_typed_reader", "SRC-1", f"WITH {M} SELECT {FLAT_SQL} FROM m")
def landed_arrays_typed_reader(spark, sf_dir):
    return landed.read_clean_arrays(spark, land_arrays(spark, sf_dir)).select(*FLAT)


@query("records_per_source_location", "SRC-3 AGG-31", f"WITH {M} SELECT location_id, count(*) AS n FROM m GROUP BY 1")
def records_per_source_location(spark, sf_dir):
    documents = landed.read_documents(spark, land_arrays(spark, sf_dir))
    records = landed.explode_records(landed.parse_documents(documents))
    named = records.select(landed.location_id_from_path(F.col("source_file")).alias("location_id"))
    return named.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


@query("tolerant_load", "SRC-6 STR-7", f"""
WITH {M}, p AS (SELECT location_id, seq // {PAGE_RECORDS} AS page, count(*) AS n FROM m GROUP BY 1, 2)
SELECT location_id, count(*) FILTER (WHERE location_id NOT IN (4, 5)) AS good_documents, count(*) FILTER (WHERE location_id = 5) AS not_json,
  count(*) FILTER (WHERE location_id = 4) AS not_array, coalesce(sum(n) FILTER (WHERE location_id NOT IN (4, 5)), 0)::BIGINT AS records FROM p GROUP BY 1""")
def tolerant_load(spark, sf_dir):
    """Location 4 lands objects in place of arrays, location 5 broken text."""

    def damage(array):
        place = F.col("location_id")
        return F.when(place == 4, F.concat(F.lit('{"results":'), array, F.lit("}"))).when(
            place == 5, F.concat(F.lit("<"), array)
        ).otherwise(array)

    parsed = landed.parse_documents(landed.read_documents(spark, land_arrays(spark, sf_dir, damage)))
    reason = F.col("reject_reason")
    return parsed.groupBy(landed.location_id_from_path(F.col("source_file")).alias("location_id")).agg(
        F.count_if(reason.isNull()).alias("good_documents"), F.count_if(reason == landed.NOT_JSON).alias("not_json"),
        F.count_if(reason == landed.NOT_ARRAY).alias("not_array"),
        F.coalesce(F.sum(F.size("records")), F.lit(0)).alias("records"),
    )


@query("quarantined_records", "SRC-6 STR-7", f"""
WITH {M} SELECT CASE WHEN k = 50 THEN 'record is not an object' WHEN k = 51 THEN 'no parameter name' ELSE 'no start time' END AS reject_reason,
  count(*) AS n FROM m WHERE k IN (50, 51, 52) GROUP BY 1""")
def quarantined_records(spark, sf_dir):
    """Records without an object, name or time, by the reason they are held back."""
    m = base.measurements(spark, sf_dir)
    record = nested_record(m)
    k = F.col("k")
    damaged = F.when(k == 50, F.lit('"text"')).when(k == 51, F.to_json(record.dropFields("parameter.name"))).when(
        k == 52, F.to_json(record.dropFields("period"))
    ).otherwise(F.to_json(record))
    records = m.select(F.lit("memory").alias("source_file"), F.try_parse_json(damaged).alias("record"))
    held = landed.rejected(landed.typed_records(records))
    return held.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("landed_pages", "SRC-5", f"WITH {M} SELECT {FLAT_SQL} FROM m")
def landed_pages(spark, sf_dir):
    path = scratch_path(spark, "pages")
    pages = document_pages(base.measurements(spark, sf_dir))
    pages.select(F.concat(F.lit('{"results":['), F.array_join("records", ","), F.lit("]}")).alias("value")).write.text(path)
    return landed.read_pages(spark, path).select(*FLAT)


@query("sensor_directory", "SRC-4", f"""
WITH {M} SELECT DISTINCT location_id, 'place ' || location_id AS location_name, sensor_id,
  CASE WHEN parameter = 'relativehumidity' THEN 'unknown' ELSE parameter END AS parameter FROM m WHERE sensor_id <> 0""")
def sensor_directory(spark, sf_dir):
    """Directory responses with nameless humidity sensors and a sensor 0."""
    m = base.measurements(spark, sf_dir)
    name = F.when(F.col("parameter") != "relativehumidity", F.col("parameter"))
    sensor = F.struct(F.col("sensor_id").alias("id"), F.struct(name.alias("name")).alias("parameter"))
    # a response lists distinct sensors of one location, of a thousand ids at most
    listed = m.select("location_id", F.floor(F.col("sensor_id") / 1000).alias("page"), sensor.alias("sensor")).distinct()
    sensors = listed.groupBy("location_id", "page").agg(F.collect_list("sensor").alias("sensors"))
    label = F.concat(F.lit("place "), F.col("location_id").cast("string"))
    location = F.struct(F.col("location_id").alias("id"), label.alias("name"), "sensors")
    path = scratch_path(spark, "directory")
    sensors.select(F.array(location).alias("results")).write.json(path)
    return landed.read_directory(spark, path)


def new_store(spark, rows: DataFrame) -> store.MeasurementStore:
    return store.MeasurementStore(spark, scratch_path(spark, "store"), rows.schema)


def silver(spark, sf_dir) -> DataFrame:
    return base.measurements(spark, sf_dir).drop("k")


@query("one_location_scan", "SRC-2 FLT-3", f"WITH {M} SELECT seq, parameter, round(value + 1e-9, 6) AS value FROM m WHERE location_id = 7")
def one_location_scan(spark, sf_dir):
    rows = silver(spark, sf_dir)
    kept = new_store(spark, rows)
    kept.append(rows)
    return kept.location(7).select("seq", "parameter", "value")


ROWS = ["seq", "location_id", "parameter", "datetime_utc", "value"]
ROWS_SQL = "seq, location_id, parameter, datetime_utc::VARCHAR AS datetime_utc, round(value + 1e-9, 6) AS value"


@query("overwritten_location", "SNK-1", f"""
WITH {M} SELECT {ROWS_SQL} FROM (SELECT * FROM m WHERE location_id <> 3 UNION ALL
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY parameter, datetime_utc ORDER BY seq) AS rn FROM m WHERE location_id = 3) WHERE rn = 1)""")
def overwritten_location(spark, sf_dir):
    """Location 3 is replaced by its merged form, the others stay."""
    rows = silver(spark, sf_dir)
    kept = new_store(spark, rows)
    kept.append(rows)
    kept.overwrite(merge.merge([rows.where("location_id = 3")]))
    return kept.read().select(*ROWS)


@query("replaced_years", "SNK-1", f"""
WITH {OM} SELECT {ROWS_SQL} FROM om WHERE location_id <> 3 OR datetime_utc >= TIMESTAMP '1998-01-01'""")
def replaced_years(spark, sf_dir):
    """A location with several years is replaced, in place, by its later ones."""
    rows = base.order_readings(spark, sf_dir)
    kept = new_store(spark, rows)
    kept.append(rows)
    kept.overwrite(kept.location(3).where("datetime_utc >= TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
    return kept.read().select(*ROWS)


INGEST_HIST = f"""{M},
hk AS (SELECT DISTINCT location_id, parameter_id, sensor_id, datetime_utc, datetime_to_utc FROM m),
bk AS (SELECT DISTINCT location_id, parameter, datetime_to_utc FROM m),
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id, parameter_id, sensor_id, datetime_utc, datetime_to_utc ORDER BY seq) AS rn FROM m) WHERE rn = 1)"""


def two_loads(spark, sf_dir) -> store.MeasurementStore:
    """A first full load and a second that overlaps it by a day."""
    rows = silver(spark, sf_dir)
    kept = new_store(spark, rows)
    plan.ingest(kept, rows.where("datetime_utc < TIMESTAMP_NTZ '2024-01-16 00:00:00'"), "2024-01-16 00:00:00", ["seq"])
    plan.ingest(kept, rows.where("datetime_utc >= TIMESTAMP_NTZ '2024-01-15 00:00:00'"), RUN_TIME, ["seq"])
    return kept


def two_rolled_up_loads(spark, sf_dir) -> Rollup:
    """The two loads with their aggregates, and the second one once more."""
    rows = silver(spark, sf_dir)
    kept = new_store(spark, rows)
    sums = Rollup(kept)
    plan.ingest(kept, rows.where("datetime_utc < TIMESTAMP_NTZ '2024-01-16 00:00:00'"), "2024-01-16 00:00:00", ["seq"], with_stats=False, rollup=sums)
    for _ in range(2):
        plan.ingest(kept, rows.where("datetime_utc >= TIMESTAMP_NTZ '2024-01-15 00:00:00'"), RUN_TIME, ["seq"], with_stats=False, rollup=sums)
    return sums


@query("rolled_up_parameter_stats", "AGG-2 SNK-2", f"""
WITH {INGEST_HIST} SELECT parameter, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, round(min(value) + 1e-9, 6) AS min, round(max(value) + 1e-9, 6) AS max,
  round(stddev_samp(value) + 1e-9, 6) AS std FROM fk GROUP BY 1""")
def rolled_up_parameter_stats(spark, sf_dir):
    return two_rolled_up_loads(spark, sf_dir).parameter_stats()


@query("rolled_up_daily_means", "AGG-6 STR-6", f"""
WITH {INGEST_HIST} SELECT parameter, location_id, datetime_local::DATE::VARCHAR AS date, round(avg(value) + 1e-9, 6) AS mean, count(*) AS n FROM fk GROUP BY ALL""")
def rolled_up_daily_means(spark, sf_dir):
    return two_rolled_up_loads(spark, sf_dir).daily_means()


@query("rolled_up_correlations", "AGG-18", f"""
WITH {INGEST_HIST}, {WIDE.replace("FROM m", "FROM fk")} SELECT * FROM ({CORRELATIONS}) WHERE samples > 0""")
def rolled_up_correlations(spark, sf_dir):
    return two_rolled_up_loads(spark, sf_dir).pair_correlations()


@query("rolled_up_locations", "AGG-23 AGG-31", f"""
WITH {INGEST_HIST}, l AS (SELECT location_id, (datetime_utc >= TIMESTAMP '2024-01-16')::INT AS load FROM fk)
SELECT location_id, count(*)::BIGINT AS total_records, count(DISTINCT load) AS runs FROM l GROUP BY 1""")
def rolled_up_locations(spark, sf_dir):
    return two_rolled_up_loads(spark, sf_dir).records_by_location()


@query("store_after_two_loads", "SNK-2 STR-1 STR-2", f"WITH {INGEST_HIST} SELECT {ROWS_SQL} FROM fk")
def store_after_two_loads(spark, sf_dir):
    return two_loads(spark, sf_dir).read().select(*ROWS)


@query("state_after_two_loads", "SNK-4 SRC-8 AGG-26", f"""
WITH {INGEST_HIST}, nk AS (SELECT location_id, parameter_id, count(*) AS n FROM (
  SELECT DISTINCT location_id, parameter_id, sensor_id, datetime_utc FROM m WHERE datetime_utc >= TIMESTAMP '2024-01-16') GROUP BY 1, 2)
SELECT location_id, parameter, max(datetime_to_utc)::VARCHAR AS last_fetch_time, coalesce(any_value(n), 0)::BIGINT AS last_records_count,
  '{RUN_TIME}' AS last_successful_run FROM m LEFT JOIN nk USING (location_id, parameter_id) GROUP BY 1, 2""")
def state_after_two_loads(spark, sf_dir):
    return two_loads(spark, sf_dir).read_state()


@query("reload_after_reset", "STR-5", f"WITH {INGEST_HIST} SELECT {ROWS_SQL} FROM fk")
def reload_after_reset(spark, sf_dir):
    """Forgetting the bookmarks loads everything again; nothing is doubled."""
    rows = silver(spark, sf_dir)
    kept = new_store(spark, rows)
    plan.ingest(kept, rows, RUN_TIME, ["seq"])
    kept.reset_state()
    again = plan.since_bookmark(rows, kept.read_state())
    plan.ingest(kept, again, RUN_TIME, ["seq"])
    return kept.read().select(*ROWS)


@query("merged_and_previous_version", "SNK-3", f"""
WITH {M} SELECT 'previous' AS version, {ROWS_SQL} FROM m UNION ALL SELECT 'current', {ROWS_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id, datetime_utc, parameter_id ORDER BY seq) AS rn FROM m) WHERE rn = 1""")
def merged_and_previous_version(spark, sf_dir):
    rows = silver(spark, sf_dir)
    path = scratch_path(spark, "versions_of")
    store.write_version(rows, path)
    merge.save_merged(merge.merge([store.current_version(spark, path, rows.schema)]), path)
    both = [
        store.current_version(spark, path, rows.schema, back).withColumn("version", F.lit(name))
        for back, name in ((0, "current"), (1, "previous"))
    ]
    return both[0].unionByName(both[1]).select("version", *ROWS)


@query("run_history", "SNK-5 SRC-9 WIN-4", f"""
WITH {R} SELECT run_id, start_time::VARCHAR AS start_time, n::DOUBLE AS fetched FROM rn ORDER BY rn.start_time DESC, run_id DESC LIMIT 100""")
def run_history(spark, sf_dir):
    log = run_log(spark, sf_dir)
    kept = store.MeasurementStore(spark, scratch_path(spark, "run_log"), log.schema)
    kept.append_run(log.select(*schema.RUN.fieldNames()))
    return kept.read_runs(fixed.RUNS_KEPT).select("run_id", "start_time", F.col("metrics")["total_records_fetched"].alias("fetched"))


@query("exported_json", "SNK-7", f"WITH {M} SELECT {FLAT_SQL} FROM m")
def exported_json(spark, sf_dir):
    m = base.measurements(spark, sf_dir)
    path = scratch_path(spark, "export")
    store.export_json(m.select(nested_record(m).alias("r")).select("r.*"), path)
    back = spark.read.schema(schema.RAW_RECORD).json(path)
    return back.select(*landed.flat(F.struct(*back.columns))).select(*FLAT)


@query("report_file", "SNK-6 CH-16", f"""
WITH {M} SELECT count(DISTINCT location_id) + 0 AS locations, count(DISTINCT parameter) + 0 AS parameters FROM m""")
def report_file(spark, sf_dir):
    """Written report, read back: it holds a block per location and parameter."""
    path = scratch_path(spark, "report")
    store.write_report(report_query(spark, sf_dir), path)
    text = F.col("value")
    return spark.read.text(path).agg(
        F.count_if(text.contains("(ID: ")).alias("locations"), F.count_if(text.startswith("  Median:")).alias("parameters")
    )
