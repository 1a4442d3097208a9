"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Tokens are words (A-Z lower-cased) and one end for each text, known by 64-bit
hashes. Tasks count the pairs (context, token) of their texts and send them,
grouped by context, to the owner of the context's leading bits. An owner adds up its
contexts, saves them as sorted arrays, and sends for each token the number of
its contexts and its count to the owner of the token, which saves these. What
crosses the driver is one short row for each owner.

The arrays lie in a folder that all workers can open as files: the shared folder, or
``folder`` (a mounted one, where the shared folder is in a store without files). Workers
map them and look up the sorted, distinct pairs of a batch. Files are written
under another name and renamed, and are the same whoever writes them, so a
repeated task does no harm.

A null text is empty and has its end; null ids are training rows by the checksum of
the empty text; repeated rows count each; with an empty training set all
tokens are unknown and equally likely; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import bytes_of, crc_mod, documents, scratch_path, prepare_workers, stage

END, START = (xxhash.xxh64_intdigest(x) for x in (b"\n", b"\r"))  # no word holds these
FLUSH = 4_000_000
HIGH = np.uint64(0xFFFF << 48)


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of all texts in a row, and where each text starts."""
    words = [t.lower().split() for t in texts]
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    after = np.full(int(lengths.sum()), END, np.uint64)
    is_word = np.ones(len(after), bool)
    is_word[starts + lengths - 1] = False
    after[is_word] = np.fromiter(map(xxhash.xxh64_intdigest, (w for ws in words for w in ws)), np.uint64, int(is_word.sum()))
    before = np.roll(after, 1)
    before[starts] = START
    return before, after, starts


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)) * np.uint64(owners) >> np.uint64(16)).astype(np.int64)


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The context's leading bits, so that keys lie with their owner, and 48 mixed bits."""
    m = (u * np.uint64(0x9E3779B97F4A7C15) + v) * np.uint64(0xBF58476D1CE4E5B9)
    m = (m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (u & HIGH) | (m >> np.uint64(16))


def summed(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with their counts."""
    order = np.lexsort((v, u))
    u, v, c = u[order], v[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
    return u[first], v[first], np.add.reduceat(c, first)


def narrow(c: np.ndarray) -> list[np.ndarray]:
    """Counts in one byte each, those from 255 on beside them."""
    return [np.minimum(c, 255).astype(np.uint8), c[c >= 255].astype(np.uint64)]


def wide(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large.astype(np.int64)
    return out


def packed(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpacked(blob: bytes, kinds: list) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


PAIRS = [np.uint64, np.uint32, np.uint64, np.uint8, np.uint64]
WORDS = [np.uint64, np.uint32, np.uint8, np.uint64]


def count_pairs(owners: int):
    def blobs(u, v) -> pd.DataFrame:
        u, v, c = summed(u, v, np.ones(len(u), np.int64))
        cuts = np.searchsorted(owner_of(u, owners), np.arange(owners + 1))
        out = []
        for o in range(owners):
            own = slice(cuts[o], cuts[o + 1])
            if own.stop > own.start:
                contexts, n = np.unique(u[own], return_counts=True)
                out.append((o, packed([contexts, n.astype(np.uint32), v[own], *narrow(c[own])])))
        return pd.DataFrame(out, columns=["owner", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(tokens(pdf["text"])[:2])
            n += len(held[-1][0])
            if n >= FLUSH:
                yield blobs(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield blobs(*map(np.concatenate, zip(*held)))

    return run


def save(folder: str, name: str, array: np.ndarray) -> None:
    path = f"{folder}/{name}.npy"
    part = f"{path}.{os.getpid()}"
    os.makedirs(folder, exist_ok=True)
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def merge_contexts(folder: str, owners: int):
    """Saves an owner's pairs and contexts; sends tokens' numbers of contexts and counts on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        o = int(pdf["owner"].iloc[0])
        parts = [unpacked(b, PAIRS) for b in pdf["blob"]]
        u, v, c = summed(
            np.concatenate([np.repeat(p[0], p[1]) for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([wide(p[3], p[4]) for p in parts]))
        keys = pair_key(u, v)
        order = np.argsort(keys)
        small, large = narrow(c[order])
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        kinds = [np.add.reduceat((c == i).astype(np.uint32) if i < 3 else (c >= 3).astype(np.uint32), first) for i in (1, 2, 3)]
        for name, array in (("keys", keys[order]), ("counts", small), ("large", large), ("full", np.flatnonzero(small == 255)), ("contexts", u[first]),
                            ("totals", np.add.reduceat(c, first)), ("kinds", np.column_stack(kinds))):
            save(folder, f"{o:05d}-{name}", array)
        words, inverse, n = np.unique(v, return_inverse=True, return_counts=True)
        uses = np.bincount(inverse, c, len(words)).astype(np.int64)
        cuts = np.searchsorted(owner_of(words, owners), np.arange(owners + 1))
        stats = [int((c == i).sum()) for i in (1, 2, 3, 4)]
        out, sizes = [], [len(keys), len(first), len(large)]
        for p in range(owners):
            own = slice(cuts[p], cuts[p + 1])
            if own.stop > own.start:
                out.append((p, packed([words[own], n[own].astype(np.uint32), *narrow(uses[own])]), *stats, o, *sizes))
                stats, sizes = [0, 0, 0, 0], [0, 0, 0]
        return pd.DataFrame(out, columns=["owner", "blob", "n1", "n2", "n3", "n4", "sender", "pairs", "contexts", "large"])

    return run


def merge_words(folder: str):
    """Saves an owner's tokens; gives the sums the model needs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        o = int(pdf["owner"].iloc[0])
        parts = [unpacked(b, WORDS) for b in pdf["blob"]]
        words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        types = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        uses = np.bincount(inverse, np.concatenate([wide(p[2], p[3]) for p in parts]), len(words)).astype(np.int64)
        for name, array in (("words", words), ("types", types), ("uses", uses)):
            save(folder, f"{o:05d}-{name}", array)
        m = [int((types == i).sum()) for i in (1, 2, 3, 4)]
        sums = (*(int(pdf[f"n{i}"].sum()) for i in (1, 2, 3, 4)), *m, len(words), int(types.sum()), int(uses.sum()))
        # a row with the sums and this owner's tokens, and one for each sender that told its sizes here
        told = pdf[pdf["pairs"] > 0]
        rows = [(*sums, o, 0, 0, 0, len(words))]
        rows += [(*[0] * len(STATS), *r, 0) for r in zip(told["sender"].tolist(), told["pairs"].tolist(), told["contexts"].tolist(), told["large"].tolist())]
        return pd.DataFrame(rows, columns=[*STATS, "owner", *SIZES])

    return run


SIZES = ["pairs", "contexts", "large", "words"]
STATS = ["n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "vocabulary", "types", "tokens"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The three discounts of the modified form, by count (0, 1, 2, 3 or more); halves where a count of counts is missing."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = [i - (i + 1) * y * (b / a) if a and b else y * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0] + [min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(out, 1)])


_MAPPED: dict[str, list] = {}
#: Which number of a model's sizes says how long an array is.
SIZE_OF = {
    "keys": "pairs", "counts": "pairs", "large": "large", "full": "large", "contexts": "contexts", "totals": "contexts", "kinds": "contexts",
    "words": "words", "types": "words", "uses": "words",
}


@dataclass(frozen=True)
class Model:
    folder: str
    owners: int
    stats: dict[str, int] = field(hash=False)
    #: Entries of each owner's pair, context and token arrays; an owner that is not listed has none.
    sizes: dict[str, dict[int, int]] = field(hash=False)

    def arrays(self, name: str) -> list:
        """The owners' arrays of a name, memory-mapped; None where an owner has nothing.

        A file that should be there and is not, or has another length, is an error: without it scores would be wrong.
        """
        at = f"{self.folder}/{name}"
        if at not in _MAPPED:
            _MAPPED[at] = [self._array(name, o) for o in range(self.owners)]
        return _MAPPED[at]

    def _array(self, name: str, owner: int) -> np.ndarray | None:
        size = self.sizes[SIZE_OF[name]].get(owner)
        if not size:
            return None
        path = f"{self.folder}/{owner:05d}-{name}.npy"
        found = np.load(path, mmap_mode="r")  # a missing file raises
        if len(found) != size:
            raise OSError(f"{path} has {len(found)} entries in place of {size}")
        return found

    def find(self, name: str, wanted: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice, np.ndarray]]]:
        """Which of the sorted values are there, and by owner where."""
        cuts = np.searchsorted(owner_of(wanted, self.owners), np.arange(self.owners + 1))
        there, at = np.zeros(len(wanted), bool), []
        for o, array in enumerate(self.arrays(name)):
            own = slice(cuts[o], cuts[o + 1])
            if array is None or own.stop == own.start:
                continue
            place = np.minimum(np.searchsorted(array, wanted[own]), len(array) - 1)
            there[own] = array[place] == wanted[own]
            at.append((o, own, place))
        return there, at

    def values(self, name: str, found: tuple, column: str) -> np.ndarray:
        there, at = found
        arrays = self.arrays(column)
        out = None
        for o, own, place in at:
            got = np.asarray(arrays[o][place])
            if out is None:
                out = np.zeros((len(there), *got.shape[1:]), np.int64)
            out[own] = got
        out = np.zeros(len(there), np.int64) if out is None else out
        out[~there] = 0
        return out

    def pair_counts(self, found: tuple) -> np.ndarray:
        out = self.values("keys", found, "counts")
        for o, own, place in found[1]:
            big = np.flatnonzero(out[own] == 255)
            if len(big):  # the n-th full byte belongs to the n-th large count
                out[own.start + big] = self.arrays("large")[o][np.searchsorted(self.arrays("full")[o], place[big])]
        return out

    def logs(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its log10 probability, its base's, and whether it is known."""
        s = self.stats
        words, word_at = np.unique(after, return_inverse=True)
        found = self.find("words", words)
        types, uses = self.values("words", found, "types"), self.values("words", found, "uses")
        v, total, n = s["vocabulary"], s["types"], s["tokens"]
        base = np.log10((uses + 0.5) / (n + 0.5 * (v + 1)))
        if total:
            d = discounts(s["m1"], s["m2"], s["m3"], s["m4"])
            more = v - s["m1"] - s["m2"]
            rest = (d[1] * s["m1"] + d[2] * s["m2"] + d[3] * more) / total
            low = np.maximum(types - d[np.minimum(types, 3)], 0) / total + rest / (v + 1)
        else:
            low = np.ones(len(words))
        p = low[word_at]

        contexts, context_at = np.unique(before, return_inverse=True)
        found_c = self.find("contexts", contexts)
        totals = self.values("contexts", found_c, "totals")
        if found_c[0].any():
            d = discounts(s["n1"], s["n2"], s["n3"], s["n4"])
            kinds = self.values("contexts", found_c, "kinds").reshape(len(contexts), -1)
            kept = kinds @ d[1:] / np.maximum(totals, 1)
            keys, key_at = np.unique(pair_key(before, after), return_inverse=True)
            c = self.pair_counts(self.find("keys", keys))[key_at]
            t = totals[context_at]
            p = np.where(t > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(t, 1) + kept[context_at] * p, p)
        return np.log10(p), base[word_at], (uses > 0)[word_at]

    def scorer(self):
        model = self

        @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
        def score(text: pd.Series) -> pd.DataFrame:
            if not len(text):
                return pd.DataFrame({"n_tokens": [], "n_known": [], "base_score": [], "score": []})
            before, after, starts = tokens(text)
            p, base, known = model.logs(before, after)
            return pd.DataFrame({
                "n_tokens": np.diff(np.append(starts, len(after))), "n_known": np.add.reduceat(known.astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(p, starts),
            })

        return score


def local_folder(spark, folder: str | None) -> str:
    path = folder or scratch_path(spark, "model")
    path = path.removeprefix("file:")
    if "://" in path.lstrip("/") or not path.startswith("/"):
        raise ValueError("name a mounted folder for the model's arrays: the shared folder is in a store without files")
    return "/" + path.lstrip("/")


def fit(df: DataFrame, folder: str | None = None, owners: int | None = None) -> Model:
    """Counts the texts of ``df`` and saves the model's arrays."""
    spark = df.sparkSession
    prepare_workers(spark)
    owners = owners or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2**15)
    folder = local_folder(spark, folder)
    pairs = df.select(bytes_of().alias("text")).mapInPandas(count_pairs(owners), "owner int, blob binary")
    told = "owner int, blob binary, n1 long, n2 long, n3 long, n4 long, sender int, pairs long, contexts long, large long"
    words = pairs.groupBy("owner").applyInPandas(merge_contexts(folder, owners), told)
    told = ", ".join(f"{c} long" for c in STATS) + ", owner int, " + ", ".join(f"{c} long" for c in SIZES)
    sums = stage(words.groupBy("owner").applyInPandas(merge_words(folder), told), "sums")
    found = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS]).first()
    sizes = sums.groupBy("owner").agg(*[F.sum(c).alias(c) for c in SIZES]).collect()  # a row for each owner
    return Model(folder, owners, found.asDict(), {c: {r["owner"]: r[c] for r in sizes if r[c]} for c in SIZES})


def scored(df: DataFrame, model: Model) -> DataFrame:
    """Adds ``n_tokens, n_known, base_score, score`` and ``perplexity``."""
    out = df.withColumn("__llm_s", model.scorer()(bytes_of()))
    out = out.withColumns({c: F.col(f"__llm_s.{c}") for c in ("n_tokens", "n_known", "base_score", "score")}).drop("__llm_s")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out() -> Column:
    return crc_mod("doc_id", 5) == 1


def query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs.filter(~held_out()))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.stats["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
