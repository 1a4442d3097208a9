"""Near copies by the similarity of word shingles: SimHash groups and MinHash bands for candidates, exact Jaccard similarity for the verdict.

A text is lower-cased (A-Z) and cut into words; its set holds the XXH64 of each distinct
shingle of ``SHINGLE`` words (fewer words: the whole sequence is the only shingle).
Two texts are linked if the Jaccard similarity of their sets is ``SIMILARITY`` or more. Groups are
the connected components of the links. Equal sets are one node from the start.

Candidates lie in one SimHash group (``simhash.groups``: fingerprints, blocks, Hamming distance, components), or share one of
``BANDS`` keys, each made of ``ROWS`` least hashes. Fingerprints of 64 bits find the closest copies only, as pairs at 0.8
differ in some ten bits; such a pair shares no key with a probability of (1 - 0.8**5)**32, 3 in a million, and more similar pairs
less often. That is the only way to lose a link.

Texts that share keys, over any number of steps, are a circle; links lie inside circles. Sets are made again for texts in
circles, and each circle's sets are brought together in one task, so a set is sent once, however many keys it shares. Circles of more than ``CELL``
texts go key by key, in rounds of some bands: after each round links are merged to components, and the next
one takes only keys whose nodes still lie in several (of keys with the same nodes one is enough); a key with
more than ``CELL`` nodes is cut into cells, and each pair of cells is a group of its own. No size switch changes a result.

A task compares sets that share one of their rarest shingles, which any linked pair does, where the place of that
shingle leaves enough for the similarity and as long as their groups differ; it returns the edges of a spanning forest, never all pairs.

Null texts are empty and near copies of each other; null ids are no group's smallest id unless all are null;
repeated rows are members like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm import simhash
from airloom.llm.common import FILE, ROW, bytes_of, prepare_workers, stage, with_row_key
from airloom.llm.simhash import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
#: The bands at which rounds end. Four find 97 % of the pairs at 0.9.
ROUNDS = (4, 12, BANDS)
#: These only size work: texts that meet in one task, sets compared at once, kinds of sets tried as one.
CELL = 2048
AT_ONCE = 1024
KINDS = 2048
GROUP = ["key", "cell", "other"]

_RANDOM = np.random.default_rng(42)
_XOR = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.lower().split()
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def band_keys(shingles: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[at:at + 1024, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def sketcher(shingle: int):
    @F.pandas_udf("node long, keys array<long>")
    def sketch(text: pd.Series) -> pd.DataFrame:
        sets = [shingles_of(t, shingle) for t in text]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "keys": [np.array(band_keys(s), np.uint64).view(np.int64) for s in sets]})

    return sketch


def set_maker(shingle: int):
    @F.pandas_udf(T.BinaryType())
    def make(text: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t, shingle).tobytes() for t in text], dtype=object)

    return make


class Components:
    """Labels of sets that are joined pair by pair; the smaller of two groups takes the other's label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        gone = self.members.pop(b)
        self.label[gone] = a
        self.members[a] += gone
        return True


def may_link(similarity: float, n: np.ndarray, rest: np.ndarray, m, more) -> np.ndarray:
    """Whether sets of n and m shingles can be linked that first meet in one with ``rest`` and ``more`` left behind it."""
    return 1 + np.minimum(rest, more) >= similarity / (1 + similarity) * (n + m) - 1e-9


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges (place, place) that connect what is linked, at most one for each set."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ids = rank[ids]  # the rarer, the smaller
    own = [np.sort(ids[a:a + n]) for a, n in zip(starts, sizes)]
    # A linked pair has so much in common that it shares one of its first n - least + 1 shingles.
    firsts = [o[:len(o) - int(np.ceil(similarity * len(o) - 1e-9)) + 1] for o in own]
    lengths = [len(f) for f in firsts]
    tokens, places = np.concatenate(firsts), np.repeat(np.arange(len(sets)), lengths)
    behind = sizes[places] - np.concatenate([np.arange(n) for n in lengths]) - 1
    order = np.argsort(tokens, kind="stable")
    cuts = np.flatnonzero(np.diff(tokens[order])) + 1
    found, mark, out = Components(len(sets)), np.zeros(len(counts), bool), []
    label = found.label
    for left, rest in zip(np.split(places[order], cuts), np.split(behind[order], cuts)):
        if len(left) < 2 or (label[left] == label[left[0]]).all():
            continue
        n, tries = sizes[left], range(len(left) - 1)
        if len(left) > 64:
            # Sets alike in size and place are tried as one: most of a common template's readers drop out here.
            kinds, kind, many = np.unique(np.stack([n, rest]), axis=1, return_inverse=True, return_counts=True)
            if kinds.shape[1] <= KINDS:
                fits = [may_link(similarity, *kinds, *k) for k in kinds.T]
                some = np.array([f.sum() - (f[i] and many[i] == 1) > 0 for i, f in enumerate(fits)])
                tries = np.flatnonzero(some[kind.ravel()][:-1])
        for i in tries:
            one = left[i]
            near = (label[left[i + 1:]] != label[one]) & may_link(similarity, n[i + 1:], rest[i + 1:], n[i], rest[i])
            others = left[i + 1:][near]
            for at in range(0, len(others), AT_ONCE):
                some = others[at:at + AT_ONCE]
                some = some[label[some] != label[one]]
                if not len(some):
                    continue
                mark[own[one]] = True
                common = np.add.reduceat(mark[np.concatenate([own[r] for r in some])].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                mark[own[one]] = False
                for r in some[common >= similarity * (sizes[one] + sizes[some] - common) - 1e-9]:
                    if found.join(one, r):
                        out.append((int(one), int(r)))
    return out


def links(similarity: float):
    """Edges among rows (key, cell, other, node, shingles) that come sorted; a group may go on in the next batch."""

    def edges(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
        for _, rows in pdf.groupby(GROUP, sort=False):
            nodes = rows["node"].to_numpy()
            for a, b in linked([np.frombuffer(s, np.uint64) for s in rows["shingles"]], similarity):
                yield nodes[a], nodes[b]

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(np.array(list(edges(pdf)), np.int64).reshape(-1, 2), columns=["u", "v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            first, end = pdf[GROUP].iloc[0], pdf[GROUP].iloc[-1]
            if held and not first.equals(held[0][GROUP].iloc[0]):
                yield frame(pd.concat(held))
                held = []
            last = (pdf[GROUP] == end).all(axis=1)
            if not last.all():
                yield frame(pd.concat([*held, pdf[~last]]))
                held = []
            held.append(pdf[last])
        if held:
            yield frame(pd.concat(held))

    return run


def _in_cells(members: DataFrame) -> DataFrame:
    """Nodes of a key with more than ``CELL`` of them are dealt to cells, and every two cells are a group of their own."""
    cells = F.ceil(F.col("n") / CELL).cast("int")
    cell = F.pmod(F.xxhash64("node"), cells).cast("int")
    dealt = members.select("key", "node", cell.alias("own"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("with"))
    return dealt.select("key", F.least("own", "with").alias("cell"), F.greatest("own", "with").alias("other"), "node")


def _fingerprint_keys(keyed: DataFrame, narrow: DataFrame) -> DataFrame:
    """``node, band, key`` of the nodes in SimHash groups of several rows: a group is a key, taken in the first round."""
    alike = stage(simhash.groups(keyed).filter("group_size > 1").select(FILE, ROW, "root"), "simhash_groups")
    key = F.xxhash64(F.lit("simhash"), "root")
    return narrow.join(alike, [FILE, ROW]).select("node", F.lit(0).alias("band"), key.alias("key"))


def _circles(met: DataFrame) -> DataFrame:
    """``node, circle, size`` of all nodes that share a key (with ``least``, the key's least node) with another one."""
    found = components(met.select(F.col("node").alias("u"), F.col("least").alias("v")))
    found = stage(found.union(found.select(F.col("v").alias("u"), "v").distinct()), "circle_members").withColumnsRenamed({"u": "node", "v": "circle"})
    return found.join(stage(found.groupBy("circle").agg(F.count("*").alias("size")), "circle_sizes"), "circle")


def _compared(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges among the sets of each group."""
    return sets.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(links(similarity), "u long, v long")


def _linked_by_key(keyed: DataFrame, wanted: DataFrame, met: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges among the nodes of large circles, which meet key by key in rounds of some bands."""
    sets = stage(keyed.join(wanted.hint("merge"), [FILE, ROW]).select("node", set_maker(shingle)(bytes_of()).alias("shingles")), "sets")
    keys = stage(met.join(sets.select("node"), "node", "left_semi").select("node", "band", "key"), "large_keys")
    roots = stage(wanted.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0), "roots")
    for first_band, end in zip((0, *ROUNDS), ROUNDS):
        # Only keys whose nodes still lie in several components can add a link.
        own = keys.filter(F.col("band").between(first_band, end - 1))
        own = own.join(roots.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = own.groupBy("key").agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.min("root").alias("low"), F.max("root").alias("high"),
        ).filter("n > 1 AND low <> high")
        several = stage(several.groupBy("n", "who").agg(F.min("key").alias("key")), "several")
        pairs = stage(_in_cells(own.join(several.select("n", "key"), "key")), "pairs")
        edges = stage(_compared(pairs.join(sets, "node").select(*GROUP, "node", "shingles"), similarity), "links")
        roots = components(roots.union(edges))
    return roots


def groups(keyed: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One narrow row for every row with a key: ``doc_id, component_id, group_size, kept``; one row of each component is kept."""
    prepare_workers(keyed.sparkSession)
    narrow = stage(keyed.select("doc_id", FILE, ROW, sketcher(shingle)(bytes_of()).alias("s")).select("doc_id", FILE, ROW, "s.node", "s.keys"), "sketches")
    # A small key first: ids that are there before missing ones, then ids, then places.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)
    nodes = stage(narrow.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n")), "nodes")

    keys = narrow.select("node", F.posexplode("keys").alias("band", "key")).union(_fingerprint_keys(keyed, narrow))
    met = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").drop("most")
    met = stage(keys.join(stage(met, "shared_keys"), "key").distinct(), "met")
    # Nodes that are joined by shared keys, over any number of steps; links lie inside these circles.
    circles = stage(_circles(met), "circles")
    first = nodes.select("node", f"first.{FILE}", f"first.{ROW}")
    small = stage(circles.filter(F.col("size") <= CELL).join(first, "node"), "in_small_circles")
    sets = keyed.join(small.hint("merge"), [FILE, ROW]).select(  # as it must be for many texts, so at every size
        F.col("circle").alias("key"), F.lit(0).alias("cell"), F.lit(0).alias("other"), "node", set_maker(shingle)(bytes_of()).alias("shingles"))
    edges = stage(_compared(sets, similarity), "links")
    large = stage(circles.filter(F.col("size") > CELL).join(first, "node"), "in_large_circles")
    if not large.isEmpty():
        edges = edges.union(_linked_by_key(keyed, large, met, shingle, similarity))
    roots = components(edges)

    named = nodes.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    named = stage(named.withColumn("root", F.coalesce("root", "node")), "roots")
    first = stage(named.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("group_size")), "firsts")
    named = stage(named.select("node", "root").join(first, "root"), "named")
    return narrow.join(named, "node").select(
        "doc_id", FILE, ROW, F.col("first.doc_id").alias("component_id"), "group_size",
        ((F.col(FILE) == F.col(f"first.{FILE}")) & (F.col(ROW) == F.col(f"first.{ROW}"))).alias("kept"),
    )


def drop_near_copies(df: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each component, the one with the smallest id; its columns are unchanged."""
    keyed = with_row_key(df)
    gone = stage(groups(keyed, shingle, similarity).filter("NOT kept").select(FILE, ROW), "dropped")
    return keyed.join(gone, [FILE, ROW], "left_anti").drop(FILE, ROW)
