"""Failure streaks and their alerts over a stream of runs: one counter per run history, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from airloom import fixed_values as fixed
from airloom.plans.runs import ALERT, recovery_events, streak_alerts
from airloom.session import stage
from airloom.sources.store import read_or_empty

#: What a history's state holds: the last run counted and the streak it ended with.
STATE = T.StructType([
    T.StructField("last_start", T.LongType()), T.StructField("last_run", T.StringType()), T.StructField("streak", T.LongType()),
])
RUN = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("start_time", T.TimestampNTZType()), T.StructField("outcome", T.StringType()),
])
ALERT_ROW = T.StructType([T.StructField("timestamp", T.TimestampNTZType()), *[T.StructField(c, T.StringType()) for c in ALERT[1:]]])


def count_on(rows: pd.DataFrame, last: tuple[int, str] | None, streak: int) -> pd.DataFrame:
    """Streaks of the runs after the ``last`` one counted, in the order of (start_time, run_id).

    Runs up to the last one are repeats, or came too late to change what was said.
    """
    rows = rows.drop_duplicates(["start_time", "run_id"]).sort_values(["start_time", "run_id"])
    if last is not None:
        at = rows["start_time"].astype("datetime64[us]").astype("int64")
        rows = rows[(at > last[0]) | ((at == last[0]) & (rows["run_id"] > last[1]))]
    failed = rows["outcome"] != "success"
    island = (~failed).cumsum()
    # the streak goes on from the state up to the first success
    counted = failed.astype("int64").groupby(island).cumsum() + (failed & (island == 0)) * streak
    before = failed.shift(fill_value=streak > 0)
    return rows.assign(streak=counted, recovered=~failed & before)


def streaks_stream(runs: DataFrame, by: list[str]) -> DataFrame:
    """``by, run_id, start_time, outcome, streak, recovered`` of each run, once.

    The state of a history is one counter, whatever the number of its runs.
    Runs must arrive in the order of their start times; those of one batch may come in any order.
    """
    names = [*by, *RUN.fieldNames()]
    out = T.StructType([
        *[runs.schema[c] for c in by], *RUN.fields, T.StructField("streak", T.LongType()), T.StructField("recovered", T.BooleanType()),
    ])

    def advance(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak = None, 0
        if state.exists:
            at, run, streak = state.get
            last = at, run
        found = count_on(pd.concat(pdfs, ignore_index=True), last, streak)
        if len(found):
            end = found.iloc[-1]
            state.update((int(end["start_time"].value // 1000), end["run_id"], int(end["streak"])))
            yield found[[f.name for f in out.fields]]

    return runs.select(*names).groupBy(*by).applyInPandasWithState(advance, out, STATE, "append", GroupStateTimeout.NoTimeout)


def send_alerts(streaks: DataFrame, path: str, checkpoint: str, limit: int = fixed.MAX_CONSECUTIVE_FAILURES) -> StreamingQuery:
    """Alerts and recoveries of a stream of streaks as rows, each batch in a folder of its own.

    A batch that is run again after a failure replaces its folder, so every alert is there once.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch = stage(batch, "streaks")
        alerts = streak_alerts(batch, limit).unionByName(recovery_events(batch))
        alerts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return streaks.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sent_alerts(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, ALERT_ROW).select(*ALERT)


def read_runs_stream(spark: SparkSession, path: str, row_type: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Runs in the order in which their files were added to the log."""
    reader = spark.readStream.schema(row_type)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
