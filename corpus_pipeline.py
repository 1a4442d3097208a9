"""Five stages from raw documents to packed token sequences.

Rejected texts go first, then exact copies, then near copies (one row of each
group stays), the rest is mixed to target weights, and what was chosen is
packed. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airloom.llm import classifier, exact, mixing, near, packing
from airloom.llm.common import documents, stage
from airloom.session import configure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.drop_rejected(docs, classifier.labels_of(spark, sf_dir)).select(COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_copies(docs).select(COLUMNS)  # SimHash groups are checked exactly; MinHash adds what 64 bits cannot tell at a similarity of 0.8


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers come to this stage with the memory of the ones before, so they remember fewer words
    return packing.pack(docs, packing.default_tokenizer(), generation=100_000)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_minhash_near_dedup", near_dedup),
    ("mix_to_weights", mixing_stage),
    ("harmonic_packing", packing_stage),
]

#: Trained models, XXH64 and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = documents(configure(spark), sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
