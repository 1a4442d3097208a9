"""Row types of raw records, flat measurements, ingest state and run log."""

from pyspark.sql import types as T

_times = T.StructType([T.StructField("utc", T.StringType()), T.StructField("local", T.StringType())])

RAW_RECORD = T.StructType([
    T.StructField("value", T.DoubleType()),
    T.StructField("parameter", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("units", T.StringType()),
    ])),
    T.StructField("period", T.StructType([
        T.StructField("interval", T.StringType()),
        T.StructField("datetimeFrom", _times),
        T.StructField("datetimeTo", _times),
    ])),
    T.StructField("locationId", T.LongType()),
    T.StructField("location", T.StringType()),
    T.StructField("sensors", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
    ]))),
    T.StructField("coordinates", T.StructType([
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ])),
])

RAW_PAGE = T.StructType([T.StructField("results", T.ArrayType(RAW_RECORD))])

LOCATION_DIRECTORY = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("sensors", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()),
            T.StructField("parameter", T.StructType([T.StructField("name", T.StringType())])),
        ]))),
    ]))),
])

STATE = T.StructType([
    T.StructField("location_id", T.LongType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("last_fetch_time", T.TimestampNTZType()),
    T.StructField("last_records_count", T.LongType()),
    T.StructField("last_successful_run", T.TimestampNTZType()),
])

RUN = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("errors", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    ]))),
])

# Composite keys: the ingest key names one reading of one sensor, the merge
# key one reading of one parameter at a place and time.
INGEST_KEY = ["location_id", "parameter_id", "sensor_id", "datetime_utc", "datetime_to_utc"]
MERGE_KEY = ["location_id", "datetime_utc", "parameter_id"]

QUARANTINE = T.StructType([
    T.StructField("location_id", T.LongType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("reject_reason", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("ingest_run", T.StringType()),
])
