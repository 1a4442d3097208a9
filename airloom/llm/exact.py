"""Exact deduplication by a Golomb-coded fingerprint exchange.

Texts are equal when identical after lower-casing A-Z (a null text is empty).
Of equal texts the row with the largest id stays; null ids come last, and rows
that share text and id are told apart by their place in the table.

1. Every row gets a 64-bit fingerprint; ids and fingerprints are written once.
2. A sender (a run of fingerprints of one task) sorts its distinct
   fingerprints, cuts them by owner (leading bits) and codes the gaps of each
   piece as Golomb-Rice bits. A text that a sender holds many times is sent
   once and marked as a suspect on the spot, so hot copies cost one code a sender.
3. An owner decodes its pieces and returns a bitmap for each: which
   fingerprints another sender holds too.
4. Senders turn the bitmaps into suspects. Only suspects' texts are shuffled,
   compared byte by byte as grouping keys, with copies combined before the shuffle.

An owner gets about ``FINGERPRINTS_PER_OWNER`` codes, whatever the size of the
input. An empty table gives an empty result; result columns replace columns of
the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm.common import FILE, ROW, ascii_lower, bytes_of, documents, prepare_workers, stage, text_of, with_row_key

FINGERPRINTS_PER_OWNER = 2**22
FINGERPRINTS_PER_SENDER = 2**20


def rice_encode(values: np.ndarray, base: int) -> tuple[int, bytes]:
    """Sorted distinct values from ``base`` on: the number of remainder bits, and the packed bits."""
    gaps = np.diff(values, prepend=np.uint64(base))
    k = max(0, int(np.log2(max(float(gaps.mean(dtype=np.float64)), 1.0))))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rests = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(rests).tobytes() + np.packbits(unary).tobytes()


def rice_decode(n: int, k: int, bits: bytes, base: int) -> np.ndarray:
    raw = np.frombuffer(bits, np.uint8)
    cut = -(-n * k // 8)
    rests = np.unpackbits(raw[:cut], count=n * k).reshape(n, k).astype(np.uint64)
    gaps = (rests << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    ends = np.flatnonzero(np.unpackbits(raw[cut:]))[:n]
    gaps += (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def base_of(owner: int, bits: int) -> int:
    return owner << (64 - bits) if bits else 0


def sender(bits: int):
    """Codes runs of fingerprints: one row for each owner, with the suspects the sender sees itself."""

    def coded(name: str, fps: np.ndarray) -> pd.DataFrame:
        values, counts = np.unique(fps, return_counts=True)
        owners = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        out = []
        for owner in np.unique(owners):
            own = owners == owner
            k, code = rice_encode(values[own], base_of(int(owner), bits))
            out.append((name, int(owner), int(own.sum()), k, code, np.packbits(counts[own] > 1).tobytes()))
        return pd.DataFrame(out, columns=["sender", "owner", "n", "k", "code", "seen"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, part = [], 0, 0
        for pdf in batches:
            held.append(pdf["fp"].to_numpy().view(np.uint64))
            rows += len(pdf)
            if rows >= FINGERPRINTS_PER_SENDER:
                yield coded(f"{TaskContext.get().partitionId()}-{part}", np.concatenate(held))
                held, rows, part = [], 0, part + 1
        if rows:
            yield coded(f"{TaskContext.get().partitionId()}-{part}", np.concatenate(held))

    return run


def owner_marks(bits: int):
    """For every piece, which of its fingerprints other pieces hold too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = [rice_decode(n, k, code, base_of(o, bits)) for n, k, code, o in zip(pdf["n"], pdf["k"], pdf["code"], pdf["owner"])]
        values, counts = np.unique(np.concatenate(pieces), return_counts=True)
        twice = values[counts > 1]
        return pdf[["sender", "owner"]].assign(bitmap=[np.packbits(np.isin(p, twice)).tobytes() for p in pieces])

    return run


def suspects(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, k, code, o, seen, bitmap in zip(pdf["n"], pdf["k"], pdf["code"], pdf["owner"], pdf["seen"], pdf["bitmap"]):
                marked = np.unpackbits(np.frombuffer(seen, np.uint8) | np.frombuffer(bitmap, np.uint8), count=n)
                yield pd.DataFrame({"fp": rice_decode(n, k, code, base_of(o, bits))[marked > 0].view(np.int64)})

    return run


@F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("sha", T.StringType())]))
def prints(text: pd.Series) -> pd.DataFrame:
    low = [t.lower() for t in text]
    fps = np.array([xxhash.xxh64_intdigest(t) for t in low], np.uint64).view(np.int64)
    return pd.DataFrame({"fp": fps, "sha": [hashlib.sha256(t).hexdigest() for t in low]})


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([xxhash.xxh64_intdigest(t.lower()) for t in text], np.uint64).view(np.int64))


def suspect_fingerprints(narrow: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once in ``narrow.fp``, by the exchange."""
    n = narrow.count()
    bits = max(0, (n // FINGERPRINTS_PER_OWNER).bit_length(), 5)
    sent = stage(narrow.select("fp").mapInPandas(sender(bits), "sender string, owner int, n int, k int, code binary, seen binary"), "codes")
    marks = sent.select("sender", "owner", "n", "k", "code").groupBy("owner").applyInPandas(
        owner_marks(bits), "sender string, owner int, bitmap binary")
    back = sent.join(stage(marks, "bitmaps"), ["sender", "owner"])
    return stage(back.mapInPandas(suspects(bits), "fp long").distinct(), "suspects")


def copies(keyed: DataFrame) -> DataFrame:
    """One narrow row for every row with a key: ``doc_id, text_sha256, keep_id, group_size, kept``."""
    prepare_workers(keyed.sparkSession)
    p = F.col("__llm_p")
    narrow = stage(keyed.select("doc_id", FILE, ROW, prints(bytes_of()).alias("__llm_p")).select(
        "doc_id", FILE, ROW, p["fp"].alias("fp"), p["sha"].alias("sha")), "prints")
    found = suspect_fingerprints(narrow)

    texts = keyed.select("doc_id", FILE, ROW, text_of().alias("text"), fingerprint(bytes_of()).alias("fp"))
    texts = texts.join(found, "fp", "left_semi").withColumn("text", ascii_lower(F.col("text")))
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", FILE, ROW)
    groups = texts.groupBy("text").agg(F.min("fp").alias("fp"), F.max(place).alias("last"), F.count("*").alias("group_size"))
    groups = stage(groups.filter("group_size > 1").select(
        "fp", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("last.doc_id").alias("keep_id"),
        F.col(f"last.{FILE}").alias("keep_file"), F.col(f"last.{ROW}").alias("keep_row"), "group_size"), "groups")

    out = narrow.join(groups, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", FILE, ROW, F.col("sha").alias("text_sha256"), F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row")))).alias("kept"),
    )


def drop_copies(df: DataFrame) -> DataFrame:
    """``df`` without the rows whose text stays elsewhere; its columns are unchanged."""
    keyed = with_row_key(df)
    gone = stage(copies(keyed).filter("NOT kept").select(FILE, ROW), "dropped")
    return keyed.join(gone, [FILE, ROW], "left_anti").drop(FILE, ROW)


def query(spark, sf_dir):
    found = copies(with_row_key(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t"""
