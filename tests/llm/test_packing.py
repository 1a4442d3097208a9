import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from airloom.llm import packing

PATH = packing.default_tokenizer()
TEXTS = [
    None, "", "  \n\t", "One, two.", "don't stop... it's 1,000 (ok)!!! x,y. a.,", "Über ÉCOLE naïve, ﬁn. ΣΑΣ İx K",
    "á e b c\x85d ́lone", "<|endoftext|> x <|startoftext|>.", "日本語、テキスト。 12345", "word " * 5000, "Same. text", "Same. text", "U.S.A. e.g., i.e.",
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, class string")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(found, rows):
    """Every id of every row lies in one piece, and sequences are full from 0 without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = {d: ids_of(t) for d, t in rows}
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[d])
            own = want[d][at:at + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
            at += r.length
        assert at == len(want[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return by_sequence


def test_every_id_in_one_piece(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    found = packing.pack(frame(spark, [(*r, "c") for r in rows]), PATH).collect()
    check(found, rows)


def test_many_rows_have_little_padding(spark):
    rows = [(i, f"some words of text {i} " * (1 + i * 7 % 90)) for i in range(1500)]
    used = [sum(r.length for r in s) for s in check(packing.pack(frame(spark, [(*r, "c") for r in rows]).repartition(7), PATH).collect(), rows).values()]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padded < 0.01 * sum(used)


def test_sequences_hold_the_ids(spark):
    rows = [(i, f"text number {i}. " * 100) for i in range(50)]
    packed = packing.pack(frame(spark, [(*r, "c") for r in rows]), PATH, with_ids=True)
    held = packing.sequences(packed).collect()
    assert sum(len(r.ids) // 4 for r in held) == sum(len(ids_of(t)) for _, t in rows)


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, 2047, 2048, 2049, 9999])
def test_cut_is_whole(n):
    assert sum(packing.cut(n)) == n and all(0 < x <= 2048 for x in packing.cut(n))


def test_first_fit_never_overfills():
    pdf = pd.DataFrame({"length": [1024, 700, 700, 63, 63, 5], "worker": 0, "at": range(6)})
    out = packing.first_fit(2048)(pdf)
    assert out.groupby("bin")["length"].sum().max() <= 2048


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y")], T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())]))
    assert {r.doc_id for r in packing.pack(df, PATH).collect()} == {"a", None}
