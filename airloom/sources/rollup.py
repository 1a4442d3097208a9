"""Aggregates of a store, kept up to date from what each ingest adds.

Every run writes partial aggregates of its own rows to a partition of its own;
readers merge them. A partition is replaced as a whole, so a repeated run
changes nothing. A run is noted before its rows are stored and again when its
partials are complete: ``catch_up`` makes up for runs that ended in between.

* ``daily``: count, sum, squared deviations, extremes per parameter, location and local day, from the new rows alone.
* ``pairs``: what the run changed in the co-moments of two parameters side by side. A late reading moves the mean of its
  place and time, so the old contribution of the times touched is taken off and the new one put on; only
  their (location, month) partitions are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom import fixed_values as fixed
from airloom.operators.joins import null_safe_join
from airloom.session import stage
from airloom.sources.store import MeasurementStore, read_or_empty

DAILY_KEY = ["parameter", "location_id", "date"]
PLACE = ["location_id", "datetime_utc"]
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
#: Spread below this share of the squares is rounding, not spread.
NO_SPREAD = 1e-12

_RUN = [T.StructField("ingest_run", T.StringType())]
DAILY = T.StructType([
    T.StructField("parameter", T.StringType()), T.StructField("location_id", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("n", T.LongType()), T.StructField("n_values", T.LongType()), T.StructField("total", T.DoubleType()),
    T.StructField("spread", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), *_RUN,
])
PAIRS = T.StructType([
    T.StructField("parameter_x", T.StringType()), T.StructField("parameter_y", T.StringType()), T.StructField("n", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in SUMS[1:]], *_RUN,
])
NOTE = T.StructType([*_RUN, T.StructField("complete", T.BooleanType())])


def partials(rows: DataFrame) -> DataFrame:
    """Mergeable aggregates per parameter, location and local day."""
    return rows.groupBy("parameter", "location_id", F.to_date("datetime_local").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"),
        (F.var_pop("value") * F.count("value")).alias("spread"), F.min("value").alias("low"), F.max("value").alias("high"),
    )


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``n, mean, min, max, std`` per key; no value gives NULL, one value no deviation."""
    values, total = F.sum("n_values"), F.sum("total")
    mean = total / F.nullif(values, F.lit(0))
    between = F.sum(F.col("total") * F.col("total") / F.nullif("n_values", F.lit(0))) - total * mean
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), mean.alias("mean"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.when(values > 1, F.sqrt(F.greatest(F.sum("spread") + between, F.lit(0.0)) / (values - 1))).alias("std"),
    )


def pair_changes(rows: DataFrame, is_new: Column, pairs=tuple(fixed.SCATTER_PAIRS)) -> DataFrame:
    """Change of each pair's co-moments, from all rows of the places and times with new rows."""
    names = sorted({p for pair in pairs for p in pair})
    sides = {"before": F.when(~is_new, F.col("value")), "after": F.col("value")}
    cells = [F.avg(F.when(F.col("parameter") == p, v)).alias(f"{side}_{p}") for p in names for side, v in sides.items()]
    wide = rows.groupBy(*PLACE).agg(*cells)

    def moments(side: str, a: str, b: str) -> list[Column]:
        x, y = F.col(f"{side}_{a}"), F.col(f"{side}_{b}")
        both = x.isNotNull() & y.isNotNull()
        return [F.sum(F.when(both, v)) for v in (F.lit(1), x, y, x * x, y * y, x * y)]

    sums = []
    for i, (a, b) in enumerate(pairs):
        for name, new, old in zip(SUMS, moments("after", a, b), moments("before", a, b)):
            sums.append((F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).alias(f"{name}{i}"))
    listed = F.array(*[
        F.struct(F.lit(a).alias("parameter_x"), F.lit(b).alias("parameter_y"), *[F.col(f"{s}{i}").alias(s) for s in SUMS])
        for i, (a, b) in enumerate(pairs)
    ])
    return wide.agg(*sums).select(F.inline(listed))


class Rollup:
    """Partial aggregates beside a store's measurements."""

    def __init__(self, store: MeasurementStore):
        self.store, self.spark = store, store.spark
        self.root = f"{store.root}/rollup"

    def begin(self, run: str) -> None:
        self._note(run, False)

    def add(self, run: str, touched_rows: DataFrame) -> None:
        """Partials of a stored run. ``touched_rows``: rows of the store's partitions that the run wrote to."""
        is_new = F.col("ingest_run").eqNullSafe(F.lit(run))
        new = touched_rows.where(F.col("ingest_run") == run)
        self._write(partials(new), "daily", run)
        times = stage(new.select(*PLACE).distinct(), "touched_times")
        side_by_side = null_safe_join(touched_rows.select(*PLACE, "parameter", "value", "ingest_run"), times, PLACE, "left_semi")
        self._write(pair_changes(side_by_side, is_new), "pairs", run)
        self._note(run, True)

    def pending(self) -> DataFrame:
        """Runs that began and whose partials are not complete."""
        notes = read_or_empty(self.spark, f"{self.root}/notes", NOTE)
        return notes.groupBy("ingest_run").agg(F.bool_or("complete").alias("complete")).where(~F.col("complete")).select("ingest_run")

    def catch_up(self) -> int:
        """Adds what an ended run left out; returns how many runs there were."""
        runs = [r["ingest_run"] for r in self.pending().collect()]  # runs that crashed since the last load
        for run in runs:
            self.add(run, self.store.partitions_of(run))
        return len(runs)

    def daily(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/daily", DAILY)

    def parameter_stats(self) -> DataFrame:
        return merged(self.daily(), ["parameter"])

    def daily_means(self) -> DataFrame:
        return merged(self.daily(), DAILY_KEY).select(*DAILY_KEY, "mean", "n")

    def records_by_location(self) -> DataFrame:
        """Records and the number of runs that brought some."""
        return self.daily().groupBy("location_id").agg(F.sum("n").alias("total_records"), F.count_distinct("ingest_run").alias("runs"))

    def pair_correlations(self) -> DataFrame:
        """Pearson r and sample count of each pair; no spread gives NULL, pairs without samples are left out."""
        sums = read_or_empty(self.spark, f"{self.root}/pairs", PAIRS).groupBy("parameter_x", "parameter_y").agg(*[F.sum(s).alias(s) for s in SUMS])

        def spread(squares: str, total: str) -> Column:
            own = F.col(squares) - F.col(total) * F.col(total) / F.col("n")
            return F.when(own > F.col(squares) * NO_SPREAD, own)

        joint = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
        r = joint / F.sqrt(spread("sxx", "sx") * spread("syy", "sy"))
        return sums.where("n > 0").select("parameter_x", "parameter_y", r.alias("correlation"), F.col("n").alias("samples"))

    def _write(self, df: DataFrame, name: str, run: str) -> None:
        (
            df.withColumn("ingest_run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("ingest_run").parquet(f"{self.root}/{name}")
        )

    def _note(self, run: str, complete: bool) -> None:
        self.spark.range(1, numPartitions=1).select(F.lit(run).alias("ingest_run"), F.lit(complete).alias("complete")).write.mode("append").parquet(
            f"{self.root}/notes")
