"""Helpers shared by the operators of this folder.

Text rules used by several of them: white space is the six ASCII characters
``\\x20 \\x09-\\x0D``, lower-casing touches A-Z only, and a null text is empty.
``bytes.split()`` and ``bytes.lower()`` follow exactly these rules.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.session import scratch_path, stage  # noqa: F401  (for the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"

FILE, ROW, PATH = "__llm_file", "__llm_row", "__llm_path"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def prepare_workers(spark: SparkSession) -> None:
    """Bound what readers, Arrow batches and writers hold of whole texts, and let workers find this package where it lies."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("parquet.block.size", str(32 * 2**20))
    # Workers are reused by later stages: let them give back what a stage has freed.
    spark.sparkContext.environment.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1000000"})
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bytes_of(column: str = "text") -> Column:
    return text_of(column).cast("binary")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased. ``lower`` does just that where all characters are ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    """The words of a text in order; keep the result in a column of its own before it is used in a lambda."""
    return F.filter(F.split(c, SPACE_CLASS + "+"), lambda w: w != "")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def with_row_key(df: DataFrame, path: bool = False) -> DataFrame:
    """Adds a key of every row: a hash of its file's path and its place in the file.

    The key costs no shuffle and no scan, is the same in every run over the same
    files, and tells repeated rows apart. ``df`` is a read of Parquet files,
    filtered or projected at most; anything else is first written to the shared
    folder.
    """
    try:
        meta = df.metadataColumn("_metadata")
        keyed = df.withColumns({FILE: F.xxhash64(meta["file_path"]), ROW: meta["row_index"]} | ({PATH: meta["file_path"]} if path else {}))
        keyed.schema  # resolves the names
        return keyed
    except AnalysisException:
        return with_row_key(stage(df, "rows"), path)
