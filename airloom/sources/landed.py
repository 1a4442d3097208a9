"""Readers of landed JSON: record arrays, response pages, sensor directories.

Documents are parsed one by one into VARIANT values. A bad document or record
goes to quarantine and never takes its neighbours along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom import schema
from airloom.functions import calendar
from airloom.functions.text import location_id_from_path

NOT_JSON = "document is not JSON"
NOT_ARRAY = "document is not an array of records"
TOO_LONG = "document has no readable array and is too long to tell why"
#: A document longer than one VARIANT is read record by record, but cannot be looked at as a whole.
VARIANT_BYTES = 128 * 2**20
#: Room for the positions of one file in ``seq``.
POSITIONS = 10**15
# Typed parts of a record; a part of another type is NULL, the rest stays.
_OPEN_RECORD = (
    "struct<value: double, parameter: variant, locationId: bigint, sensors: array<struct<id: bigint>>, sensorId: bigint, "
    "period: struct<datetimeFrom: struct<utc: string, local: string>, datetimeTo: struct<utc: string>>>"
)


def read_documents(spark: SparkSession, path: str | list[str], whole_files: bool = True) -> DataFrame:
    """(source_file, document text).

    ``whole_files`` reads one array per file, pretty-printed or not. Without
    it every line is a document of its own, which splits into many tasks: the
    layout to land large volumes in.
    """
    text = spark.read.text(path, wholetext=whole_files)
    return text.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("document"))


def parse_documents(documents: DataFrame, field: str | None = None) -> DataFrame:
    """Adds the parsed records array and the reason a document is unusable.

    The array is the document itself or its ``field``. Each record becomes a
    VARIANT of its own, so only a record has a size limit, not a document.
    """
    if field is None:
        records = F.from_json("document", "array<variant>")
    else:
        records = F.from_json("document", f"struct<`{field}`: array<variant>>")[field]
    unread = F.col("records").isNull()
    not_json = F.when(F.octet_length("document") > VARIANT_BYTES, TOO_LONG).otherwise(NOT_JSON)
    reason = F.when(unread & F.try_parse_json("document").isNull(), not_json).when(unread, NOT_ARRAY)
    return documents.withColumn("records", records).withColumn("reject_reason", reason)


def explode_records(parsed: DataFrame) -> DataFrame:
    """One row per record with its position; unusable documents give none."""
    kept = [c for c in parsed.columns if c not in ("document", "records", "reject_reason")]
    return parsed.select(*kept, F.posexplode("records").alias("position", "record"))


def with_arrival_order(records: DataFrame) -> DataFrame:
    """Adds ``seq``: files in an arbitrary fixed order, records by position.

    Needs one document per file. A number made from the file name takes no
    shuffle and is the same on every run. It is a decimal with room for the
    whole 64-bit hash and the position, is never negative, and fits the buffers of hash aggregates.
    """
    number = F.xxhash64("source_file").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    first = number * F.lit(POSITIONS).cast("decimal(16,0)")
    return records.withColumn("seq", (first + F.col("position").cast("decimal(15,0)")).cast("decimal(38,0)"))


def quarantined_documents(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NOT NULL").select("source_file", "document", "reject_reason")


def typed_records(records: DataFrame, adapt_plain_parameter: bool = False) -> DataFrame:
    """Flat columns of VARIANT records plus ``reject_reason``.

    The location is the record's own, else the one in the file name; if both
    are there and differ, the record is rejected. ``adapt_plain_parameter``
    accepts a parameter given as plain text with a top-level ``sensorId``.
    """
    opened = records.selectExpr(
        *records.columns, f"try_variant_get(record, '$', '{_OPEN_RECORD}') AS _r",
    ).selectExpr("*", "try_variant_get(_r.parameter, '$', 'struct<id: bigint, name: string, units: string>') AS _p")
    if adapt_plain_parameter:
        plain = "CASE WHEN schema_of_variant(_r.parameter) = 'STRING' THEN try_variant_get(_r.parameter, '$', 'string') END"
        name, sensor = f"coalesce(_p.name, {plain})", "coalesce(get(_r.sensors, 0).id, _r.sensorId)"
    else:
        name, sensor = "_p.name", "get(_r.sensors, 0).id"
    start, local = F.col("_r.period.datetimeFrom.utc"), F.col("_r.period.datetimeFrom.local")
    typed = F.struct(
        F.col("_r").isNotNull().alias("_object"),
        F.col("_r.locationId").alias("_own"), location_id_from_path(F.col("source_file")).alias("_named"),
        F.col("_p.id").alias("parameter_id"), F.expr(name).alias("parameter"), F.col("_p.units").alias("units"),
        F.col("_r.value").alias("value"), calendar.parse_utc(start).alias("datetime_utc"),
        calendar.parse_local(local).alias("datetime_local"), calendar.utc_offset(local).alias("utc_offset"),
        calendar.parse_utc(F.col("_r.period.datetimeTo.utc")).alias("datetime_to_utc"), F.expr(sensor).alias("sensor_id"),
    )
    # unpacking through a generator keeps later filters from repeating the parsing
    typed = opened.withColumn("_typed", typed).select(*records.columns, F.inline(F.array("_typed")))
    reason = (
        F.when(~F.col("_object"), "record is not an object")
        .when(F.col("_own") != F.col("_named"), "location differs from file name")
        .when(F.col("parameter").isNull(), "no parameter name")
        .when(F.col("datetime_utc").isNull(), "no start time")
    )
    flat_names = [c for c in typed.columns if c not in ("record", "_object", "_own", "_named")]
    return typed.select(
        *flat_names, F.coalesce("_own", "_named").alias("location_id"), reason.alias("reject_reason"),
        F.to_json("record").alias("raw"),
    )


def accepted(typed: DataFrame) -> DataFrame:
    return typed.where("reject_reason IS NULL").drop("reject_reason", "raw")


def rejected(typed: DataFrame) -> DataFrame:
    return typed.where("reject_reason IS NOT NULL")


def flat(record: Column) -> list[Column]:
    """Flat columns of a record read with the fixed struct type."""
    start = record["period"]["datetimeFrom"]
    return [
        record["locationId"].alias("location_id"),
        record["parameter"]["id"].alias("parameter_id"),
        record["parameter"]["name"].alias("parameter"),
        record["parameter"]["units"].alias("units"),
        record["value"].alias("value"),
        calendar.parse_utc(start["utc"]).alias("datetime_utc"),
        calendar.parse_local(start["local"]).alias("datetime_local"),
        calendar.utc_offset(start["local"]).alias("utc_offset"),
        calendar.parse_utc(record["period"]["datetimeTo"]["utc"]).alias("datetime_to_utc"),
        F.get(record["sensors"], F.lit(0))["id"].alias("sensor_id"),
    ]


def read_clean_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Fast reader of well-formed location files, straight to flat columns."""
    raw = spark.read.schema(schema.RAW_RECORD).option("multiLine", True).json(path)
    record = F.struct(*raw.columns)
    return raw.select(F.col("_metadata.file_path").alias("source_file"), record.alias("record")).select(
        "source_file", *flat(F.col("record"))
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of landed response pages, one page per line."""
    pages = spark.read.schema(schema.RAW_PAGE).json(path)
    return pages.select(F.explode("results").alias("record")).select(*flat(F.col("record")))


def quarantined_pages(spark: SparkSession, path: str) -> DataFrame:
    """Lines that ``read_pages`` cannot use, with the reason."""
    return quarantined_documents(parse_documents(read_documents(spark, path, whole_files=False), "results"))


def sensors_of(directories: DataFrame) -> DataFrame:
    """Sensors of the first location in each directory response.

    Sensors without an id (or with id 0) are left out.
    """
    first = directories.select(F.get("results", F.lit(0)).alias("_loc"))
    sensors = first.select(
        F.col("_loc.id").alias("location_id"), F.col("_loc.name").alias("location_name"),
        F.explode("_loc.sensors").alias("_s"),
    )
    return sensors.where(F.coalesce(F.col("_s.id"), F.lit(0)) != 0).select(
        "location_id", "location_name", F.col("_s.id").alias("sensor_id"),
        F.coalesce("_s.parameter.name", F.lit(fixed.UNKNOWN_PARAMETER)).alias("parameter"),
    )


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return sensors_of(spark.read.schema(schema.LOCATION_DIRECTORY).json(path))
