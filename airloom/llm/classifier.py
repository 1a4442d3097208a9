"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Features of a text are its words, pairs of words, and pairs of word shapes,
each hashed to a bucket. A shape is a word's case, its last character's kind
and whether it repeats the word before. Two multinomial models over the
buckets are counted: the target model from texts labelled good, at most ``MAX_LABELS``
labelled rows (those with the least hash of their id), and the raw model
from all rows. A text's ratio is the mean over its features of
log p(target) - log p(raw), without the text's own counts.

A ratio is accepted from the cut on that best parts the labelled rows (without
bad labels: the least ratio of the good ones). The cut is the log of the prior odds a feature has to
overcome: a text's log weight is the sum over its features of the log ratio less the cut, whatever their number. With k accepted texts, the k
largest sums of log weight and Gumbel noise are kept; a text's noise comes from
its id and content, so equal rows stay or go together, and rows that tie with
the k-th stay. The k-th largest sum is found by counting, three times 2**16 bins.

A null text is empty, has no features and a ratio of zero, and so has a text of
one word only its word's ratio. An empty table gives an empty result, and
without good labels all rows are kept. Result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import FILE, ROW, bytes_of, documents, prepare_workers, stage, with_row_key

MAX_LABELS = 50_000
WORD_BUCKETS = 2**14
SHAPES = 32
BUCKETS = WORD_BUCKETS + SHAPES * SHAPES
SMOOTHING = 0.5
SEED = 42
CACHE = 60_000
STEPS = 2**20
#: Sums of log weight and noise are placed on a scale that ends here; texts beyond either end tie.
ENDS = 2.0**26


class Features(dict):
    """A word's hash and shape, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode("utf-8", "replace")
        case = 2 if text.isupper() and len(text) > 1 else 1 if text[:1].isupper() else 0 if text[:1].isalpha() else 3
        end = text[-1]
        last = 0 if end.isalnum() else 1 if end in ".,;:" else 2 if end in "!?" else 3
        # 58 bits of hash above 4 bits of shape
        found = self[word] = (xxhash.xxh64_intdigest(word) >> 6) << 4 | case * 4 + last
        return found


_FEATURES = Features()


def buckets(text: bytes) -> np.ndarray:
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(_FEATURES.__getitem__, words), np.int64, n)
    hashes, shapes = both >> 4, both & 15
    shapes[1:] += 16 * (hashes[1:] == hashes[:-1])
    pairs = (hashes[:-1] * 1_000_003 + hashes[1:]) * -7046029254386353131
    return np.concatenate([hashes % WORD_BUCKETS, (pairs >> 40) % WORD_BUCKETS, WORD_BUCKETS + shapes[:-1] * SHAPES + shapes[1:]])


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's counts of each bucket in target and raw texts."""
    sums = np.zeros((2, BUCKETS), np.int64)
    for pdf in batches:
        for text, target in zip(pdf["text"], pdf["target"]):
            own = np.bincount(buckets(text), minlength=BUCKETS)
            sums[1] += own
            if target:
                sums[0] += own
    yield pd.DataFrame({"bucket": np.arange(BUCKETS), "target": sums[0], "raw": sums[1]})


def labelled_sample(labels: DataFrame, column: str, limit: int = MAX_LABELS) -> DataFrame:
    """One row for each labelled id, at most ``limit`` of them: small enough to broadcast whatever the table's size."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias(column))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(keyed: DataFrame, labels: DataFrame) -> np.ndarray:
    """Counts of the buckets: row 0 the target model's, row 1 the raw model's."""
    prepare_workers(keyed.sparkSession)
    sample = stage(labelled_sample(labels, "quality"), "labelled").withColumnRenamed("quality", "__llm_quality")
    rows = keyed.select("doc_id", bytes_of().alias("text")).join(F.broadcast(sample), "doc_id", "left")
    rows = rows.select("text", F.coalesce(F.col("__llm_quality") == 1, F.lit(False)).alias("target"))
    sums = rows.mapInPandas(counted, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw"))
    out = np.zeros((2, BUCKETS))
    for b, t, r in sums.collect():  # one row for each bucket
        out[:, b] = t, r
    return out


def scorer(model: np.ndarray):
    """The mean log ratio of a text and its number of features."""
    sums = model.sum(axis=1)

    def ratios(text: bytes, target: bool) -> tuple[float, int]:
        found = buckets(text)
        if not len(found) or not sums[0]:
            return 0.0, len(found)
        # A text's own counts would make it look raw, or like the target, by being in the model.
        which, inverse, own = np.unique(found, return_inverse=True, return_counts=True)
        t, r = model[:, which]
        n = len(found)
        t, nt = (t - own, sums[0] - n) if target else (t, sums[0])
        r, nr = r - own, sums[1] - n
        log = np.log((t + SMOOTHING) / (nt + SMOOTHING * BUCKETS)) - np.log((np.maximum(r, 0) + SMOOTHING) / (max(nr, 0) + SMOOTHING * BUCKETS))
        return float((log * own).sum() / n), n

    @F.pandas_udf("ratio double, n_features long")
    def score(text: pd.Series, target: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ratios(t, y) for t, y in zip(text, target)], columns=["ratio", "n_features"])

    return score


def best_cut(ratios: np.ndarray, good: np.ndarray) -> float:
    """The middle of the gap that parts good and bad labels with the fewest errors, a lost good one counting ten times."""
    if not good.any():
        return -np.inf
    if good.all():
        return float(ratios.min())
    order = np.argsort(ratios, kind="stable")
    r, g = ratios[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)])  # good ones below a cut before place i
    let_in = (~g).sum() - np.concatenate([[0], np.cumsum(~g)])
    i = int(np.argmin(10 * lost + let_in))
    if i == 0:
        return float(r[0])
    return float((r[i - 1] + r[i]) / 2) if i < len(r) else float(r[-1])


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest value of the column ``place`` (0 to 2**48), by counts of 16 bits at a time."""
    prefix = 0
    for shift in (32, 16, 0):
        bins = keys.filter(F.shiftright("place", shift + 16) == prefix).groupBy(
            F.shiftright("place", shift).bitwiseAND(0xFFFF).alias("b")).count().orderBy(F.desc("b")).collect()  # 2**16 rows at most
        for b, n in bins:
            if k <= n:
                break
            k -= n
        prefix = (prefix << 16) | b
    return prefix


def scores(keyed: DataFrame, labels: DataFrame, seed: int = SEED) -> tuple[DataFrame, int]:
    """One narrow row for every row with a key: ``doc_id, ratio, log_weight, noise, place``; and the place from which rows are kept."""
    model = fit(keyed, labels)
    sample = stage(labelled_sample(labels, "quality"), "labelled").withColumnRenamed("quality", "__llm_quality")
    rows = keyed.select("doc_id", FILE, ROW, "text").join(F.broadcast(sample), "doc_id", "left")
    s = scorer(model)(bytes_of(), F.coalesce(F.col("__llm_quality") == 1, F.lit(False)))
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(2**52)) + 0.5) / float(2**52)
    rows = rows.select("doc_id", FILE, ROW, "__llm_quality", s.alias("s"), unit.alias("unit"))
    rows = rows.select("doc_id", FILE, ROW, "__llm_quality", "s.ratio", "s.n_features", (-F.log(-F.log("unit"))).alias("noise"))
    rows = stage(rows, "scores")

    # One row for each labelled id, whatever the number of its rows.
    known = rows.filter(F.col("__llm_quality").isNotNull()).groupBy("doc_id").agg(F.avg("ratio").alias("ratio"), F.max("__llm_quality").alias("quality"))
    known = known.toPandas() if model[0].any() else None
    cut = -np.inf if known is None else best_cut(known["ratio"].to_numpy(), known["quality"].to_numpy() == 1)
    rows = rows.withColumn("log_weight", (F.col("ratio") - F.lit(float(cut) if np.isfinite(cut) else 0.0)) * F.col("n_features"))
    total = F.least(F.greatest(F.col("log_weight") + F.col("noise"), F.lit(-ENDS)), F.lit(ENDS))
    rows = rows.withColumn("place", F.floor((total + ENDS) * STEPS).cast("long"))
    if known is None:
        return rows, 0
    k = rows.filter(F.col("ratio") >= float(cut)).count()
    return rows, kth_largest(rows, k) if k else 2**62


def select(keyed: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    rows, least = scores(keyed, labels, seed)
    return rows.withColumn("kept", F.col("place") >= least).drop("__llm_quality", "place")


def drop_rejected(df: DataFrame, labels: DataFrame) -> DataFrame:
    keyed = with_row_key(df)
    gone = stage(select(keyed, labels).filter("NOT kept").select(FILE, ROW), "dropped")
    return keyed.join(gone, [FILE, ROW], "left_anti").drop(FILE, ROW)


def labels_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def query(spark, sf_dir):
    found = select(with_row_key(documents(spark, sf_dir).select("doc_id", "text")), labels_of(spark, sf_dir))
    return found.select("doc_id", "ratio", "n_features", "log_weight", "noise", "kept")
