"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number is its place in the table: rows of the files before it, in the
order of their paths, plus its place in its own file. The numbers come from the
files' metadata, so numbering needs no sort, no shuffle and no grouping, and no
key can be hot. A keyed permutation of ``0 .. n-1`` then gives every row its
position; ``position % shards`` is the shard and ``position // shards`` the
slot. Both can be computed for any row number without looking at other rows,
and ``row_of`` inverts them.

Nulls, empty or repeated texts and repeated ids do not matter, since only row
numbers count. An empty table gives an empty result. Result columns replace
columns of the same name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import FILE, PATH, ROW, bytes_of, documents, stage, with_row_key

PRIME = 2**31 - 1
ROUNDS = 6
WALKS = 64
OFFSET = "__llm_offset"


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of ``0 .. n-1``, as a column, as SQL and in plain Python.

    The halves live in Z_a and Z_b with a = ceil(sqrt n) and b = ceil(n / a), so
    that fewer than a numbers lie outside and a walk is rarely needed.
    """

    n: int
    seed: int = 42

    @property
    def sides(self) -> tuple[int, int]:
        a = isqrt(max(self.n, 1) - 1) + 1
        return a, -(-max(self.n, 1) // a)

    @property
    def keys(self) -> list[tuple[int, int]]:
        """Two keys for each round, from the seed."""
        digests = [hashlib.sha256(f"{self.seed}:{i}".encode()).digest() for i in range(ROUNDS)]
        return [(int.from_bytes(d[:8], "big") % PRIME, int.from_bytes(d[8:16], "big") % PRIME) for d in digests]

    def of(self, number: int) -> int:
        a, b = self.sides
        while True:
            left, right = divmod(number, b)
            for i, (k, m) in enumerate(self.keys):
                if i % 2 == 0:
                    left = (left + self._mixed(right, k, m)) % a
                else:
                    right = (right + self._mixed(left, k, m)) % b
            number = left * b + right
            if number < self.n:
                return number

    def row_of(self, position: int) -> int:
        """The row number that ``of`` sends to a position."""
        a, b = self.sides
        while True:
            left, right = divmod(position, b)
            for i, (k, m) in reversed(list(enumerate(self.keys))):
                if i % 2 == 0:
                    left = (left - self._mixed(right, k, m)) % a
                else:
                    right = (right - self._mixed(left, k, m)) % b
            position = left * b + right
            if position < self.n:
                return position

    @staticmethod
    def _mixed(x: int, k: int, m: int) -> int:
        y = (x + k) % PRIME
        return (y * y % PRIME * 48271 + m + x) % PRIME

    def column(self, number: Column) -> Column:
        """A lambda runs the rounds on a pair, a second one walks until the number is inside."""
        a, b = self.sides
        rounds = F.array(*[
            F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(k).cast("long").alias("k"), F.lit(m).cast("long").alias("m"))
            for i, (k, m) in enumerate(self.keys)
        ])

        def mixed(x: Column, r: Column) -> Column:
            y = (x + r["k"]) % PRIME
            return (y * y % PRIME * 48271 + r["m"] + x) % PRIME

        def step(s: Column, r: Column) -> Column:
            return F.when(
                r["even"], F.struct(((s["l"] + mixed(s["r"], r)) % a).alias("l"), s["r"].alias("r"))
            ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"], r)) % b).alias("r")))

        def once(x: Column) -> Column:
            start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % b).cast("long").alias("r"))
            if self.n > 2**50:  # beyond that a quotient of doubles is not exact
                raise ValueError("too many rows")
            return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])

        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALKS)), F.lit(-1).cast("long"),
            lambda acc, i: F.when((acc >= 0) & (acc < self.n), acc).otherwise(once(F.when(acc < 0, number).otherwise(acc))),
        )
        return F.when(walked < self.n, walked).otherwise(F.raise_error(F.lit("the walk is too long")).cast("long"))

    def sql(self, rows: str, walks: int = 8) -> str:
        """CTEs for DuckDB: from ``rows`` (with a column ``number``) to ``w{walks}`` with ``position``."""
        a, b = self.sides
        out = [f"w0 AS (SELECT *, number AS position, TRUE AS walking FROM {rows})"]
        for w in range(walks):
            out.append(f"w{w}r0 AS (SELECT *, position // {b} AS l, position % {b} AS r FROM w{w})")
            for i, (k, m) in enumerate(self.keys):
                x = "r" if i % 2 == 0 else "l"
                f = f"((({x} + {k}) % {PRIME} * (({x} + {k}) % {PRIME})) % {PRIME} * 48271 + {m} + {x}) % {PRIME}"
                out.append(
                    f"w{w}r{i + 1} AS (SELECT * REPLACE ("
                    + (f"(l + {f}) % {a} AS l" if i % 2 == 0 else f"(r + {f}) % {b} AS r") + f") FROM w{w}r{i})"
                )
            out.append(
                f"w{w + 1} AS (SELECT * EXCLUDE (l, r, walking) REPLACE (CASE WHEN walking THEN l * {b} + r ELSE position END AS position),"
                f" walking AND l * {b} + r >= {self.n} AS walking FROM w{w}r{ROUNDS})"
            )
        return ",\n".join(out)


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with a global ``row_number`` from 0, and the number of rows.

    ``df`` is a plain read of Parquet files. Anything else, which shows in files
    whose rows are not all there, is first written to the shared folder.
    """
    keyed = with_row_key(df, path=True)
    files = stage(keyed.groupBy(FILE, PATH).agg(F.count("*").alias("n"), (F.max(ROW) + 1).alias("places")), "files")
    seen = files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("places"), F.lit(0))).first()
    if seen[0] != seen[1]:
        return numbered(stage(df, "rows"))
    before = Window.orderBy(PATH).rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = stage(files.select(FILE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(OFFSET)), "offsets")
    rows = keyed.join(offsets, FILE).withColumn("row_number", F.col(OFFSET) + F.col(ROW))
    return rows.drop(FILE, ROW, PATH, OFFSET), seen[0]


def shard(df: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Adds ``row_number``, ``position``, ``shard`` and ``slot``.

    Shards differ by one row at most and their slots run from 0 without gaps.
    """
    rows, n = numbered(df)
    position = Permutation(n, seed).column(F.col("row_number"))
    return rows.withColumn("position", position).withColumns({
        "shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long"),
    })


def digest(df: DataFrame, shards: int = 16) -> DataFrame:
    """The columns of the query: size and checksum of every row beside its place."""
    return shard(df.select("doc_id", "text"), shards).select(
        "doc_id", (F.octet_length(bytes_of()) + 1).cast("long").alias("size"), F.crc32(bytes_of()).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir):
    return digest(documents(spark, sf_dir))
