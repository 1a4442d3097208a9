"""Streaming ingest: the batch functions inside ``foreachBatch``."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from airloom import schema
from airloom.plans.ingest import ingest
from airloom.sources.landed import flat
from airloom.sources.store import MeasurementStore


#: Order in which lines arrived: files by time, blocks of a file, lines of a block.
ARRIVAL = ["landed_at", "source_file", "file_block", "line"]
#: Batches that a backlog is cut into at most; each reads the keys of the history that it may collide with.
BACKLOG_BATCHES = 12
_LINE = T.StructType([*schema.RAW_RECORD.fields, T.StructField("_corrupt", T.StringType())])


def stream_records(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Flat measurements of landed JSON lines as a stream; see ``_measured``."""
    reader = spark.readStream.schema(_LINE).option("columnNameOfCorruptRecord", "_corrupt")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _measured(reader.json(path))


def backlog_share(spark: SparkSession, path: str, least: int) -> int:
    """Files to take per batch: ``least``, or more where the files landed so far would make over ``BACKLOG_BATCHES`` batches.

    A batch costs some jobs and a look at the history before it, so a number of batches that grew with
    the backlog would make the load grow with its square.
    """
    landed = len(spark.read.text(path).inputFiles())
    return max(least, -(-landed // BACKLOG_BATCHES))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The same lines, those landed so far, as a batch."""
    return _measured(spark.read.schema(_LINE).option("columnNameOfCorruptRecord", "_corrupt").json(path))


def _measured(raw: DataFrame) -> DataFrame:
    """Flat measurements with their place. A line that is no record, or one without
    parameter or start time, has a ``reject_reason`` and its text in ``raw``."""
    record = F.struct(*schema.RAW_RECORD.fieldNames())
    place = [F.col(f"_metadata.{c}").alias(name) for c, name in (
        ("file_path", "source_file"), ("file_modification_time", "landed_at"), ("file_block_start", "file_block"))]
    rows = raw.select(*place, record.alias("record"), "_corrupt").select(
        "source_file", "landed_at", "file_block", *flat(F.col("record")), F.coalesce("_corrupt", F.to_json("record")).alias("raw"),
        F.col("_corrupt").isNotNull().alias("_broken"),
    )
    reason = (
        F.when(F.col("_broken"), "line is not a record")
        .when(F.col("parameter").isNull(), "no parameter name")
        .when(F.col("datetime_utc").isNull(), "no start time")
    )
    return rows.withColumn("reject_reason", reason).drop("_broken")


def stream_ingest(
    records: DataFrame, store: MeasurementStore, checkpoint: str, order: list[str] = ARRIVAL,
    keys: list[str] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Deduplicate each micro-batch in itself and against all history, then append.

    ``every`` ("2 hours") keeps the query running on that cadence; without it
    everything landed so far is loaded and the query ends. A replayed batch
    adds nothing, so a restart after a failure is harmless. ``line`` counts up
    in a block, which one task reads from its start.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        ingest(store, batch.withColumn("line", F.monotonically_increasing_id()), now, order, keys, with_stats=False)

    writer = records.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
