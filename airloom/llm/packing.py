"""Harmonic packing: lengths in reciprocal-capacity classes, each bin of a class with a fixed count of pieces.

A text is its token ids and one end id. It is cut into pieces: whole sequences
of ``capacity``; from the rest the powers of two down to ``SMALL``, which are
exact reciprocals of the capacity; and one piece shorter than ``SMALL``. Pieces
of one length are a class, and a bin of the class for length l takes
``capacity // l`` of them, so only bins of short pieces have any padding (under l tokens).

Workers cut and number the pieces of each class on their own. The number of a
class's pieces before each worker is a running sum over (class, worker), and
from it every piece knows its bin, slot and offset; nothing is gathered. What
does not fill a bin, fewer than ``capacity // l`` pieces a class and so a
bounded number in all, is packed by first fit, longest first, in one task.

A null text is empty and still has its end id. Repeated rows and ids are packed
as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import bytes_of, documents, prepare_workers, stage

CAPACITY = 2048
SMALL = 64
END = 1
GENERATION = 800_000


class TokenCache(dict):
    """Ids (little-endian, 4 bytes each) of chunks without ASCII white space, for the chunks seen lately.

    The tokenizer composes characters, lower-cases and splits at white space, so a text's ids are those
    of its chunks in a row. Chunks are held with A-Z in lower case. That changes nothing where neither the
    text nor its lower-cased form has characters to compose; other texts keep their case. A text with a special token's
    literal, in any case, is not cut into chunks. A point or comma after a letter is a token
    of its own. Chunks that are new in a batch go to the tokenizer together. Of the
    chunks seen, two generations are kept; one in use passes to the younger.
    """

    def __init__(self, path: str, generation: int = GENERATION):
        from tokenizers import Tokenizer

        self.tokenizer, self.generation = Tokenizer.from_file(path), generation
        self.literals = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        """The ids of a text by the tokenizer alone."""
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def chunks(self, text: bytes, low: bytes) -> list[bytes]:
        if text.isascii():
            return low.split()
        composed = all(unicodedata.is_normalized("NFC", t.decode("utf-8", "replace")) for t in (text, low))
        return (low if composed else text).split()

    def learn(self, texts: list[list[bytes]]) -> None:
        chunks = set().union(*texts)
        new = chunks.difference(self)
        if len(self) + len(new) > self.generation:
            self.older = dict(self)
            self.clear()
            new = chunks
        self.update((c, self.older[c]) for c in new.intersection(self.older))
        new = new.difference(self)
        marked = [c for c in new if len(c) > 1 and c[-1:] in (b",", b".") and c[-2:-1].isalpha() and b"'" not in c]
        whole = list((new.difference(marked) | {c[:-1] for c in marked} | ({b",", b"."} if marked else set())).difference(self))
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in whole], add_special_tokens=False)
        self.update(zip(whole, (array("I", e.ids).tobytes() for e in found)))
        self.update((c, self[c[:-1]] + self[c[-1:]]) for c in marked)


_CACHES: dict[str, TokenCache] = {}


def token_bytes(texts: list[bytes], path: str, generation: int = GENERATION) -> list[bytes]:
    """The ids of texts, each with its end, 4 bytes an id. ``generation``: chunks remembered at a time, which only saves work."""
    if path not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for every core
        _CACHES[path] = TokenCache(path, generation)
    cache, end = _CACHES[path], END.to_bytes(4, "little")
    lower = [t.lower() for t in texts]
    chunks = [None if any(x in low for x in cache.literals) else cache.chunks(t, low) for t, low in zip(texts, lower)]
    cache.learn([c for c in chunks if c is not None])
    return [(cache.whole(t) if c is None else b"".join(map(cache.__getitem__, c))) + end for t, c in zip(texts, chunks)]


def cut(n: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Lengths of the pieces of a text with n tokens, in order."""
    whole, rest = divmod(n, capacity)
    out, size = [capacity] * whole, capacity // 2
    while size >= small:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def cutter(path: str, capacity: int, small: int, with_ids: bool, schema: pa.Schema, generation: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        worker = TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), token_bytes(batch["text"].to_pylist(), path, generation)):
                n, start = len(ids) // 4, 0
                for length in cut(n, capacity, small):
                    own = ids[4 * start:4 * (start + length)]
                    at = seen[length] = seen.get(length, -1) + 1
                    out.append((doc, start, length, zlib.crc32(own), n, worker, at) + ((own,) if with_ids else ()))
                    start += length
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def first_fit(capacity: int):
    """Bins for the pieces that are left over: ``capacity // length`` a class at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "worker", "at"], ascending=[False, True, True])
        free: list[int] = []
        bins, offsets, start = [], [], {}
        for length in pdf["length"]:
            # Bins before the first one that a piece of this length fitted in stay too full for it.
            b = start.get(length, 0)
            while b < len(free) and free[b] < length:
                b += 1
            start[length] = b
            if b == len(free):
                free.append(capacity)
            bins.append(b)
            offsets.append(capacity - free[b])
            free[b] -= length
        return pdf[["length", "worker", "at"]].assign(bin=bins, offset=offsets)

    return run


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, small: int = SMALL, with_ids: bool = False, generation: int = GENERATION) -> DataFrame:
    """Pieces of all rows: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` on request."""
    spark = df.sparkSession
    prepare_workers(spark)
    ids = ", ids binary" if with_ids else ""
    kind = df.schema["doc_id"].dataType.simpleString()
    told = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, worker int, at long{ids}"
    arrow = pa.schema([
        ("doc_id", _arrow_type(df)), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("worker", pa.int32()), ("at", pa.int64()), *([("ids", pa.binary())] if with_ids else []),
    ])
    pieces = stage(df.select("doc_id", bytes_of().alias("text")).mapInArrow(cutter(tokenizer, capacity, small, with_ids, arrow, generation), told), "pieces")

    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("length")
    counts = pieces.groupBy("length", "worker").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(whole)})
    per_bin = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    counts = counts.withColumn("bins", F.floor(F.col("total") / per_bin).cast("long"))
    classes = counts.select("length", "bins").distinct()  # at most capacity / small powers and small lengths
    classes = classes.withColumn("first_bin", F.coalesce(F.sum("bins").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = stage(counts.join(classes.drop("bins"), "length").select("length", "worker", "before", "bins", "first_bin"), "classes")

    at = F.col("before") + F.col("at")
    placed = pieces.join(counts, ["length", "worker"]).withColumns({"bin": F.floor(at / per_bin).cast("long"), "slot": at % per_bin})
    left = placed.filter("bin >= bins").select("length", "worker", "at", F.lit(0).alias("all"))
    left = left.groupBy("all").applyInPandas(first_fit(capacity), "length long, worker int, at long, bin long, offset long")
    left = stage(left.withColumnsRenamed({"bin": "late_bin", "offset": "late_offset"}), "left_over")
    bins = counts.groupBy("length").agg(F.max("bins").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]

    out = placed.join(left, ["length", "worker", "at"], "left")
    late = F.col("late_bin").isNotNull()
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(late, F.col("late_bin") + bins).otherwise(F.col("first_bin") + F.col("bin")).alias("sequence_id"),
        F.when(late, F.col("late_offset")).otherwise(F.col("slot") * F.col("length")).alias("offset"), *(["ids"] if with_ids else []),
    )


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)


def sequences(packed: DataFrame) -> DataFrame:
    """The filled sequences of ``pack(..., with_ids=True)``: ``sequence_id`` and its ids in order."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # one sequence's ids
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    return pack(documents(spark, sf_dir).select("doc_id", "text"), default_tokenizer())
