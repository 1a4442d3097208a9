"""Record validation: schema, value range and timestamp rules, scores, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom import fixed_values as fixed
from airloom.functions import calendar, nested


def range_rules(spark, ranges: dict[str, tuple[float, float]] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rules as data: (rule_parameter, lowest, highest).

    ``aliases`` gives data names that follow the rule of another name.
    """
    ranges = dict(fixed.PARAMETER_RANGES if ranges is None else ranges)
    for name, rule in (aliases or {}).items():
        ranges[name] = ranges[rule]
    rows = [(name, float(low), float(high)) for name, (low, high) in ranges.items()]
    return spark.createDataFrame(rows, "rule_parameter string, lowest double, highest double")


def opened(records: DataFrame, record: str = "record", required: list[str] = fixed.REQUIRED_FIELDS) -> DataFrame:
    """Adds ``_f``: the parts of each VARIANT record that the rules look at.

    A part is NULL where it is missing and a JSON null where it is null; the
    two objects are NULL where the value is not an object. Each part is taken
    out once, and the rules below are plain comparisons on typed columns.
    """
    fields = ", ".join(f"`{f}`: variant" for f in dict.fromkeys(["value", "parameter", "period", *required]))
    top = records.withColumn("_top", F.expr(f"try_variant_get({record}, '$', 'struct<{fields}>')"))
    parts = top.selectExpr(
        *records.columns, "_top",
        "try_variant_get(_top.parameter, '$', 'struct<id: variant, name: variant>') AS _parameter",
        "try_variant_get(_top.period, '$', 'struct<datetimeFrom: variant>') AS _period",
        "schema_of_variant(_top.value) AS _type",
    )
    return parts.selectExpr(
        *records.columns,
        *[f"_top.`{f}` IS NOT NULL AS `_has_{f}`" for f in dict.fromkeys(["parameter", "period", *required])],
        "_parameter IS NOT NULL AS _parameter_object",
        "_parameter.id IS NOT NULL AND _parameter.name IS NOT NULL AS _parameter_whole",
        "_period IS NOT NULL AS _period_object", "_period.datetimeFrom IS NOT NULL AS _period_whole",
        "try_variant_get(_parameter.name, '$', 'string') AS _name",
        "try_variant_get(_period.datetimeFrom, '$.utc', 'string') AS _start",
        "_top.value IS NOT NULL AND _type <> 'VOID' AS _given",
        "CASE WHEN _type RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)' THEN try_variant_get(_top.value, '$', 'double') END AS _number",
        "try_variant_get(_top.value, '$', 'string') AS _shown", "_type = 'BIGINT' AS _whole",
    )


def schema_errors(required: list[str] = fixed.REQUIRED_FIELDS) -> list[Column]:
    """One CASE per rule; a field that is present but null counts as present."""
    checks = [F.when(~F.col(f"`_has_{f}`"), F.lit(fixed.MISSING_FIELD + f)) for f in required]
    for name, not_object, incomplete in (
        ("parameter", fixed.PARAMETER_NOT_OBJECT, fixed.PARAMETER_INCOMPLETE),
        ("period", fixed.PERIOD_NOT_OBJECT, fixed.PERIOD_INCOMPLETE),
    ):
        trouble = F.when(~F.col(f"_{name}_object"), F.lit(not_object)).when(~F.col(f"_{name}_whole"), F.lit(incomplete))
        checks.append(F.when(F.col(f"_has_{name}"), trouble))
    return checks


def time_errors(max_age_days: int = fixed.MAX_AGE_DAYS) -> list[Column]:
    """Checks of the start time; an absent or empty one is left to the schema rules."""
    given = F.col("_start") != ""
    text = F.col("_start")
    return [
        F.when(given & ~F.col("_readable"), F.concat(F.lit(fixed.TIME_INVALID), text)),
        F.when(given & F.col("_readable") & (F.col("_age_days") < 0), F.concat(F.lit(fixed.TIME_IN_FUTURE), text)),
        F.when(
            given & F.col("_readable") & (F.col("_age_days") > max_age_days), F.concat(F.lit(fixed.TIME_TOO_OLD), text)
        ),
    ]


def range_warnings() -> list[Column]:
    """Checks of a value that a rule exists for; a null or absent value passes."""
    ruled = F.col("rule_parameter").isNotNull() & F.col("_given")
    # a fraction that is zero is not kept by the parser, but was given
    bare = F.col("_number").isNotNull() & ~F.col("_whole") & ~F.col("_shown").contains(".")
    shown = F.when(bare, F.concat(F.col("_shown"), F.lit(".0"))).otherwise(F.col("_shown"))
    low, high = (F.when(F.col(c) == F.floor(c), F.col(c).cast("long").cast("string")).otherwise(F.col(c).cast("string")) for c in ("lowest", "highest"))
    limits = F.format_string(" outside valid range [%s, %s]", low, high)
    return [
        F.when(ruled & F.col("_number").isNull(), F.concat(F.lit(fixed.VALUE_NOT_NUMERIC), F.coalesce(shown, F.lit("")))),
        F.when(
            ruled & ~F.col("_number").between(F.col("lowest"), F.col("highest")),
            F.concat(F.col("_name"), F.lit(" value "), shown, limits),
        ),
    ]


def validate(
    records: DataFrame, rules: DataFrame, as_of: str, record: str = "record",
    required: list[str] = fixed.REQUIRED_FIELDS, max_age_days: int = fixed.MAX_AGE_DAYS,
) -> DataFrame:
    """Adds ``errors``, ``warnings`` and ``valid`` to VARIANT records.

    Ranges, required fields and the age limit are the caller's. Range violations are warnings: the record stays valid. The planner
    broadcasts the rule table if its size allows.
    """
    moment = F.col("_start").try_cast("timestamp")
    at = F.lit(as_of).cast("timestamp")
    # a time in the future has a negative age, even by less than a day
    age = F.when(moment > at, F.lit(-1)).otherwise(calendar.elapsed_days(moment, at))
    timed = opened(records, record, required).withColumns({
        "_readable": F.coalesce(calendar.is_iso(F.col("_start")), F.lit(False)), "_age_days": age,
    })
    joined = timed.join(rules, F.col("_name") == F.col("rule_parameter"), "left")
    verdict = F.struct(
        nested.kept(*schema_errors(required), *time_errors(max_age_days)).alias("errors"), nested.kept(*range_warnings()).alias("warnings")
    )
    # unpacking through a generator keeps later filters from repeating the rules
    judged = joined.withColumn("_verdict", verdict).select(*records.columns, F.inline(F.array("_verdict")))
    return judged.withColumn("valid", F.size("errors") == 0)


def quality_metrics(validated: DataFrame, *keys: str) -> DataFrame:
    """Counters and score of the validated rows; no rows give a NULL score."""
    n = F.count(F.lit(1))
    return validated.groupBy(*keys).agg(
        n.alias("total_records"),
        F.count_if("valid").alias("valid_records"),
        F.count_if(~F.col("valid")).alias("invalid_records"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warnings"),
        F.try_divide(F.count_if("valid") * 100.0, n).alias("quality_score"),
    )


def first_errors(validated: DataFrame, n: int = fixed.FIRST_ERRORS, order: str = "seq") -> DataFrame:
    return validated.where(~F.col("valid")).orderBy(order).limit(n).select(order, "errors")


def first_results(validated: DataFrame, n: int = fixed.FIRST_RESULTS, order: str = "seq") -> DataFrame:
    return validated.orderBy(order).limit(n).select(order, "valid", "errors", "warnings")


def below_gate(metrics: DataFrame, least: float = fixed.MIN_QUALITY_SCORE) -> DataFrame:
    """Metrics rows that fail the gate; a NULL score means no data, not failure."""
    return metrics.where(F.col("quality_score") < least)


def too_few_records(ingest_stats: DataFrame, least: int = fixed.MIN_RECORDS_PER_LOCATION) -> DataFrame:
    return ingest_stats.where(F.col("new_records") < least)


def record_index(df: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Position of a record in its own landed document, from 0."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("index", F.row_number().over(w) - 1)
