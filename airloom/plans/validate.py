"""Validation of landed location files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.operators import quality
from airloom.operators.sampling import random_sample
from airloom.sources import landed


def validated_files(
    spark: SparkSession, path: str | list[str], as_of: str, rules: DataFrame | None = None, sample_size: int | None = None
) -> DataFrame:
    """Verdict of every record (or of a random sample) with file and position."""
    documents = landed.parse_documents(landed.read_documents(spark, path))
    records = landed.with_arrival_order(landed.explode_records(documents))
    if sample_size is not None:
        records = random_sample(records, sample_size)
    return quality.validate(records, quality.range_rules(spark) if rules is None else rules, as_of)


def file_metrics(
    spark: SparkSession, path: str | list[str], as_of: str, rules: DataFrame | None = None
) -> DataFrame:
    """Counters and score per file; a file that cannot be read has its reason in ``error``."""
    documents = landed.parse_documents(landed.read_documents(spark, path))
    unusable = landed.quarantined_documents(documents).select("source_file", F.col("reject_reason").alias("error"))
    scores = quality.quality_metrics(validated_files(spark, path, as_of, rules), "source_file")
    return scores.unionByName(unusable, allowMissingColumns=True)
