"""SimHash near-deduplication: fingerprints, pigeonhole blocks, verified Hamming distance.

A text is lower-cased (A-Z), cut into words and shingles of ``SHINGLE`` words,
repeats included (fewer words: the whole sequence is the only shingle; none:
fingerprint zero). A bit is set if it is set in over half of the shingles' XXH64.

Fingerprints at ``DISTANCE`` or fewer differing bits are linked. They are cut
into 5 blocks, of which at least 3 agree in such a pair, so each of the 10 choices
of 3 blocks is a key, and every linked pair shares a key. Equal fingerprints are
one node from the start. Rows are brought together by key and sorted, so a
task sees each key's fingerprints in a row. It compares them and returns the
edges of a spanning forest, never all pairs; a key with many fingerprints is cut again
by the pigeonhole rule on the bits the key leaves free. Groups are the
connected components of these edges.

Null texts are empty; null ids are no group's smallest id unless all are null;
repeated rows are members like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm.common import FILE, ROW, bytes_of, documents, prepare_workers, stage, with_row_key

SHINGLE = 3
DISTANCE = 2
BLOCKS = (13, 13, 13, 13, 12)
DIRECT = 4096


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(len(words) - shingle + 1, 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in text], np.uint64).view(np.int64))


def block_masks(distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks that a linked pair may agree on, the bits of those blocks."""
    blocks, at = [], 0
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [sum(chosen) for chosen in combinations(blocks, len(blocks) - distance)]


def spanning(values: np.ndarray, free: int, distance: int) -> list[tuple[int, int]]:
    """Edges (value, least value of its group) that connect what is within the distance.

    ``free``: the bits in which the values may differ.
    """
    if len(values) > DIRECT:
        bits = [1 << i for i in range(64) if free >> i & 1]
        out = []
        for i in range(distance + 1):  # one of so many parts must agree
            mask = sum(bits[i::distance + 1])
            keys = values & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            for part in np.split(values[order], np.flatnonzero(np.diff(keys[order])) + 1):
                if len(part) > 1:
                    out += spanning(part, free & ~mask, distance)
        return out
    out, left = [], np.sort(values)
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for v in frontier:
                near |= np.bitwise_count(left ^ v) <= distance
            frontier, left = left[near], left[~near]
            out += [(int(v), int(root)) for v in frontier]
    return out


def links(masks: list[int], distance: int):
    """Edges among rows (choice, key, fp) that come sorted; a key may go on in the next batch."""

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, choice = pdf["fp"].to_numpy().view(np.uint64), pdf["choice"].to_numpy()
        new = np.flatnonzero((np.diff(choice) != 0) | (np.diff(pdf["key"].to_numpy()) != 0)) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.append(starts, len(fps)))
        twos = starts[sizes == 2]  # most keys with more than one fingerprint have two
        a, b = fps[twos], fps[twos + 1]
        near = np.bitwise_count(a ^ b) <= distance
        out = [(int(u), int(v)) for u, v in zip(a[near], b[near])]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            out += spanning(fps[s:s + n], ~masks[choice[s]] & (2**64 - 1), distance)
        return pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["u", "v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["choice"] == pdf["choice"].iloc[-1]) & (pdf["key"] == pdf["key"].iloc[-1])
            held = pdf[last].reset_index(drop=True)
            if not last.all():
                yield edges(pdf[~last])
        if held is not None and len(held):
            yield edges(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: ``u`` and ``v``, the least node of its component.

    Every round is written to the shared folder; least neighbours are written
    too, so that a node with many neighbours meets them in a join AQE can split.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now, before = stage(edges.filter("u <> v").select(*pair).distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def groups(keyed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One narrow row for every row with a key: ``doc_id, fp, root, component_id, group_size, kept``; one row of each component is kept.

    ``root`` is the component's least fingerprint.
    """
    prepare_workers(keyed.sparkSession)
    narrow = stage(keyed.select("doc_id", FILE, ROW, simhash(bytes_of()).alias("fp")), "simhash")
    # A small key first: ids that are there before missing ones, then ids, then places.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)
    nodes = stage(narrow.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")), "nodes")

    masks = block_masks(distance)
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    blocks = nodes.select("fp", keys.alias("b")).select("fp", "b.choice", "b.key")
    blocks = blocks.repartition("choice", "key").sortWithinPartitions("choice", "key")
    roots = components(blocks.mapInPandas(links(masks, distance), "u long, v long"))

    named = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    named = stage(named.withColumn("root", F.coalesce("root", "fp")), "roots")
    first = stage(named.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("group_size")), "firsts")
    named = stage(named.select("fp", "root").join(first, "root"), "named")
    out = narrow.join(named, "fp")
    return out.select(
        "doc_id", FILE, ROW, "fp", "root", F.col("first.doc_id").alias("component_id"), "group_size",
        ((F.col(FILE) == F.col(f"first.{FILE}")) & (F.col(ROW) == F.col(f"first.{ROW}"))).alias("kept"),
    )


def drop_near_copies(df: DataFrame) -> DataFrame:
    """``df`` with one row of each component, the one with the smallest id; its columns are unchanged."""
    keyed = with_row_key(df)
    gone = stage(groups(keyed).filter("NOT kept").select(FILE, ROW), "dropped")
    return keyed.join(gone, [FILE, ROW], "left_anti").drop(FILE, ROW)


def query(spark, sf_dir):
    found = groups(with_row_key(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
