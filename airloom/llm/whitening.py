"""Whitening of embeddings with the covariance weighted by multiplicity.

An entry c becomes the whole number x = floor(1024 * c) + 100000. Equal x-vectors are grouped, and each distinct vector
is worked on once: its weight in the fit is the number of its rows (or 1 with ``weights="one"``).

1. Workers turn each vector into bytes (16, 32 or 64 bits an entry, the fewest that hold it); one grouping by these bytes
   counts its rows, combined before the shuffle, so a vector that a third of all rows share sends a row per task.
2. Sums and n are whole numbers, so the mean is exact. Workers centre their vectors (whole part first) and multiply
   (X * w)^T X; the partial products are summed by matrix row. The driver gets one d x d matrix, whatever the number of rows.
3. Workers project each distinct vector on the components. Rows find theirs by two 64-bit hashes, which
   are checked to tell all distinct vectors apart (else they are made anew with another seed).

Dropped: null vectors, vectors with a null, NaN or infinite entry, empty vectors, entries whose x is 2**53 or more in size, and
vectors of another length than the most frequent one (of equally frequent ones the longest). ``deviation``
is null where the exact value passes the range of a long. A component without variance to double precision has a null
``whitened`` and does not count in ``identity_error``; ``explained`` is null if there is no variance at all. Repeated rows and ids are
rows of their own, null ids are kept, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm.common import prepare_workers, stage

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
WIDTHS = (2, 4, 8)
BLOCK = 4096


def pack(vector, scale: int = SCALE) -> bytes | None:
    """The whole numbers floor(scale * c) of a vector: one byte for the width, then the entries."""
    if vector is None or not len(vector):
        return None
    c = np.array([np.nan if v is None else v for v in vector], np.float64) if np.asarray(vector).dtype == object else np.asarray(vector, np.float64)
    x = np.floor(c * scale)
    if not (np.abs(x) < 2**53 - OFFSET).all():  # NaN compares as false
        return None
    x = x.astype(np.int64)
    width = next(w for w in WIDTHS if -(2 ** (8 * w - 1)) <= x.min() and x.max() < 2 ** (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """x of a packed vector."""
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64) + OFFSET


@F.pandas_udf(T.StructType([T.StructField("packed", T.BinaryType()), T.StructField("dims", T.IntegerType())]))
def packer(vectors: pd.Series) -> pd.DataFrame:
    packed = [pack(v) for v in vectors]
    return pd.DataFrame({"packed": packed, "dims": pd.array([None if p is None else (len(p) - 1) // p[0] for p in packed], "Int32")})


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in batches:
        for at in range(0, len(pdf), BLOCK):
            part = pdf.iloc[at:at + BLOCK]
            yield part, np.stack([unpack(p) for p in part["packed"]])


def exact_sums(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of w * x by dimension, as text, for they may pass a long."""
    total = None
    for part, x in blocks(pdfs):
        w = part["w"].to_numpy(np.int64)
        if int(w.max()) * int(np.abs(x).max()) * len(w) < 2**62:
            sums = (w[:, None] * x).sum(axis=0).astype(object)
        else:
            sums = (w.astype(object)[:, None] * x.astype(object)).sum(axis=0)
        total = sums if total is None else total + sums
    if total is not None:
        yield pd.DataFrame({"i": range(len(total)), "s": [str(v) for v in total]})


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def products(n: int, sums: list[int]):
    """Rows of the weighted centred product of a task's vectors."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(sums), len(sums)))
        for part, x in blocks(pdfs):
            c = centred(x, n, sums)
            total += (c * part["w"].to_numpy(np.float64)[:, None]).T @ c
        yield pd.DataFrame({"i": range(len(sums)), "row": [r.tobytes() for r in total]})

    return run


def summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0)
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [total.tobytes()]})


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)^2, where a long holds it."""
    most = max(abs(s) for s in sums)
    if n * int(np.abs(x).max()) + most < 2**62:
        d = n * x - np.array(sums, np.int64)
        if len(sums) * int(np.abs(d).max()) ** 2 < 2**63:
            return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [v if v < 2**63 else None for v in (d * d).sum(axis=1)]


def projector(n: int, sums: list[int], vectors: np.ndarray, scales: np.ndarray):
    """Deviation and whitened components of distinct vectors."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in blocks(pdfs):
            white = centred(x, n, sums) @ vectors * scales
            yield pd.DataFrame({
                "h1": part["h1"], "h2": part["h2"], "w": part["w"],
                "deviation": pd.array(deviations(x, n, sums), "Int64"), "white": list(white),
            })

    return run


def moments(white: DataFrame, n: int, k: int) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, centred before multiplying."""
    if not k:
        return None
    w, at = F.col("w"), [F.col("white")[i] for i in range(k)]
    means = white.agg(*[F.sum(w * c) / n for c in at]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = white.agg(*[F.sum(w * (at[i] - means[i]) * (at[j] - means[j])) / n for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def distinct_vectors(rows: DataFrame, weights: str) -> tuple[DataFrame, DataFrame]:
    """Rows with two hashes of their vector, and the distinct vectors with theirs and their weight."""
    seed = 0
    while True:
        hashes = {"h1": F.xxhash64(F.lit(2 * seed), "packed"), "h2": F.xxhash64(F.lit(2 * seed + 1), "packed")}
        weight = F.count("*") if weights == "count" else F.lit(1).cast("long")
        distinct = stage(rows.groupBy("packed").agg(weight.alias("w")).withColumns(hashes), "distinct")
        if distinct.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            return rows.withColumns(hashes), distinct
        seed += 1


def whiten(df: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, weights: str = "count") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each row left and component."""
    if weights not in ("count", "one"):
        raise ValueError("weights are 'count' or 'one'")
    spark = df.sparkSession
    prepare_workers(spark)
    kind = df.schema[key].dataType.simpleString()
    rows = stage(df.select(F.col(key).alias("key"), packer(F.col(column)).alias("p")).select("key", "p.packed", "p.dims").filter("packed IS NOT NULL"), "packed")
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    told = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], told)
    d = common["dims"]
    keyed, distinct = distinct_vectors(rows.filter(F.col("dims") == d), weights)

    n = distinct.agg(F.sum("w")).first()[0]
    sums = distinct.select("packed", "w").mapInPandas(exact_sums, "i int, s string")
    sums = sums.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # d rows
    sums = [int(r["s"]) for r in sums]
    product = distinct.select("packed", "w").mapInPandas(products(n, sums), "i int, row binary")
    product = product.groupBy("i").applyInPandas(summed, "i int, row binary").collect()  # d rows of d numbers
    covariance = np.stack([np.frombuffer(r["row"]) for r in sorted(product, key=lambda r: r["i"])]) / n
    covariance = (covariance + covariance.T) / 2

    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace, k = float(np.trace(covariance)), len(values)
    live = values > d * np.finfo(float).eps * max(values[0], 0)
    live &= values > 0
    scales = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), 0)
    told_white = "h1 long, h2 long, w long, deviation long, white array<double>"
    white = stage(distinct.select("packed", "w", "h1", "h2").mapInPandas(projector(n, sums, vectors, scales), told_white), "white")
    error = moments(white, n, int(live.sum()))

    parts = F.array(*[
        F.struct(
            F.lit(i + 1).alias("component"), (F.col("white")[i] if live[i] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(float(values[i]) / trace if trace > 0 else None).cast("double").alias("explained"),
        ) for i in range(k)
    ])
    found = keyed.select("key", "h1", "h2").join(white.drop("w"), ["h1", "h2"])
    return found.select("key", "deviation", F.explode(parts).alias("c")).select(
        F.col("key").alias(key), "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )


def query(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
