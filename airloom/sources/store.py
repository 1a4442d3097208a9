"""The measurement store: partitioned Parquet, versions, ingest state, run log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom import schema
from airloom.operators.dedup import not_in
from airloom.operators.joins import null_safe_join
from airloom.session import stage

PARTITIONS = ["location_id", "event_month"]
# Spark's folder name of a missing partition value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("event_month", F.date_format("datetime_utc", "yyyy-MM"))


def read_or_empty(spark: SparkSession, path: str, row_type: T.StructType) -> DataFrame:
    """Table at ``path``; a missing one is an empty table."""
    try:
        return spark.read.schema(row_type).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], row_type)


def _arranged(df: DataFrame) -> DataFrame:
    """Rows of a partition together, large partitions over several tasks.

    REBALANCE lets AQE split a location that holds most of the data and merge
    the small ones; rows inside a file are in time order.
    """
    return with_month(df).hint("rebalance", *PARTITIONS).sortWithinPartitions(
        *PARTITIONS, F.col("datetime_utc").asc_nulls_first()
    )


class MeasurementStore:
    """Measurements under one root, partitioned by location and month.

    ``ingest_run`` names the load a row came with; rows written otherwise have
    none.
    """

    def __init__(self, spark: SparkSession, root: str, row_type: T.StructType):
        self.spark = spark
        self.root = root.rstrip("/")
        self.data = f"{self.root}/measurements"
        fields = [f for f in row_type.fields if f.name not in (*PARTITIONS, "ingest_run", "reject_reason", "raw")]
        self.row_type = T.StructType([
            *fields, T.StructField("ingest_run", T.StringType()),
            T.StructField("location_id", T.LongType()), T.StructField("event_month", T.StringType()),
        ])

    # measurements
    def read(self) -> DataFrame:
        return read_or_empty(self.spark, self.data, self.row_type)

    def read_stream(self, files_per_batch: int | None = None) -> DataFrame:
        """Rows in the order their files were added; the store must have been written to before."""
        reader = self.spark.readStream.schema(self.row_type)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(self.data)

    def location(self, location_id: int) -> DataFrame:
        """One location; other partitions are not listed for reading."""
        return self.read().where(F.col("location_id") == location_id)

    def since(self, moment: str, location_id: int | None = None) -> DataFrame:
        """Readings from ``moment`` on; earlier months are pruned, the rest is pushed down."""
        rows = self.read() if location_id is None else self.location(location_id)
        recent = F.col("event_month").isNull() | (F.col("event_month") >= moment[:7])
        return rows.where(recent & (F.col("datetime_utc") >= F.lit(moment).cast("timestamp_ntz")))

    def partitions_of(self, run: str) -> DataFrame:
        """All rows of the partitions that a load wrote to."""
        own = stage(self.read().where(F.col("ingest_run") == run).select(*PARTITIONS).distinct(), "partitions_of_run")
        return null_safe_join(self.read(), own, PARTITIONS, "left_semi")

    def append(self, new: DataFrame) -> None:
        """Add rows; columns that the store does not keep are left out."""
        kept = [c for c in self.row_type.fieldNames() if c in new.columns]
        _arranged(new.select(*kept)).write.mode("append").partitionBy(*PARTITIONS).parquet(self.data)

    def overwrite(self, df: DataFrame) -> None:
        """Replace the locations that ``df`` has rows for, with all their months, and no others.

        ``df`` may come from this store. New months are written first, then the
        months a location no longer has are removed.
        """
        df = stage(df, "replacement")
        kept = with_month(df).select(*PARTITIONS).distinct()
        held = self.read().select(*PARTITIONS).distinct()
        held = null_safe_join(held, kept.select("location_id").distinct(), ["location_id"], "left_semi")
        gone = not_in(held, kept, PARTITIONS).collect()  # names of folders
        (
            _arranged(df).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PARTITIONS).parquet(self.data)
        )
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        files = folder(self.data).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for row in gone:
            names = [f"{c}={NULL_FOLDER if row[c] is None else row[c]}" for c in PARTITIONS]
            files.delete(folder("/".join([self.data, *names])), True)

    # records that could not be used
    def quarantine(self, bad: DataFrame) -> None:
        missing = {n: F.lit(None).cast("string") for n in schema.QUARANTINE.fieldNames() if n not in bad.columns}
        bad.withColumns(missing).select(*schema.QUARANTINE.fieldNames()).write.mode("append").parquet(f"{self.root}/quarantine")

    def read_quarantine(self) -> DataFrame:
        """Rejected records of every run; a repeated run lists its own again."""
        return read_or_empty(self.spark, f"{self.root}/quarantine", schema.QUARANTINE)

    # ingest state
    def read_state(self) -> DataFrame:
        return current_version(self.spark, f"{self.root}/state", schema.STATE)

    def write_state(self, changed: DataFrame) -> None:
        """Upsert of the changed rows as a new version of the table."""
        keys = ["location_id", "parameter"]
        values = [f.name for f in schema.STATE.fields if f.name not in keys]
        new = changed.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_new_{v}") for v in values]
        )
        path = f"{self.root}/state"
        version = latest_version(self.spark, path)
        old = read_version(self.spark, path, schema.STATE, version)
        same = F.col("location_id").eqNullSafe(F.col("_k_location_id")) & F.col("parameter").eqNullSafe(
            F.col("_k_parameter")
        )
        touched = F.col("_k_location_id").isNotNull()
        merged = old.join(new, same, "full_outer").select(
            *[F.coalesce(f"_k_{k}", k).alias(k) for k in keys],
            F.greatest("_new_last_fetch_time", "last_fetch_time").alias("last_fetch_time"),
            *[F.when(touched, F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values[1:]],
        )
        write_version(merged, path, version)

    def reset_state(self) -> None:
        """Forget all bookmarks: the next ingest is a full load (and still deduplicates)."""
        write_version(self.spark.createDataFrame([], schema.STATE), f"{self.root}/state")

    # run log
    def append_run(self, run: DataFrame) -> None:
        run.write.mode("append").parquet(f"{self.root}/runs")

    def read_runs(self, keep: int | None = None) -> DataFrame:
        """The whole run log, or the ``keep`` newest runs."""
        runs = read_or_empty(self.spark, f"{self.root}/runs", schema.RUN)
        return runs if keep is None else runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(keep)


_VERSION = T.StructType([T.StructField("version", T.LongType())])


def write_version(df: DataFrame, path: str, latest: int | None = None) -> int:
    """Write a full new version beside the old ones, then record it.

    A reader sees the old version until the new one is complete; the previous
    version stays as the backup. ``latest`` saves the lookup if it is known.
    """
    spark = df.sparkSession
    version = (latest or latest_version(spark, path) or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    spark.range(version, version + 1, numPartitions=1).select(F.col("id").alias("version")).write.mode("append").parquet(
        f"{path}/versions"
    )
    return version


def latest_version(spark: SparkSession, path: str) -> int | None:
    return read_or_empty(spark, f"{path}/versions", _VERSION).agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, path: str, row_type: T.StructType, version: int | None) -> DataFrame:
    """One version of the table; none (or none that old) is an empty table."""
    if version is None or version < 1:
        return spark.createDataFrame([], row_type)
    return spark.read.schema(row_type).parquet(f"{path}/version={version}")


def current_version(spark: SparkSession, path: str, row_type: T.StructType, back: int = 0) -> DataFrame:
    """Latest version, or the one ``back`` steps before it."""
    version = latest_version(spark, path)
    return read_version(spark, path, row_type, None if version is None else version - back)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, one record per line."""
    df.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Text lines in ``line_no`` order; a report is small, so it is one file."""
    lines.orderBy("line_no").select("text").coalesce(1).write.mode("overwrite").text(path)
