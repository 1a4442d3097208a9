"""Ids and decoded texts beside the plain tokenizer, and the words' pattern beside its pre-tokenizer."""

import array
import hashlib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from airloom.llm import bpe

PATH = bpe.default_tokenizer()
PLAIN = Tokenizer.from_file(PATH)
TEXTS = [
    "", " ", "  \n\n  x ", "Hello, it's 1,000 o'clock!", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext", "naïve 漢字 😀👩‍👧 ՘x\x85\x1c\xa0y",
    "a" * 5000, "=" * 700 + "-" * 300, " " * 3000 + "x", "ab" * 3000, "word " * 2000, "\x00\x7f",
]


def ids_of(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def coded(texts):
    return [array.array("I", b"".join(parts)).tolist() for parts in bpe.codec(PATH).encode_batch(texts)]


def test_ids_are_those_of_the_tokenizer():
    assert coded(TEXTS) == [ids_of(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abest hing'\n  .,!19éü漢😀՘\x85　") | st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_ids_of_random_texts(texts):
    assert coded(texts) == [ids_of(t) for t in texts]


def test_slabs_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "SLAB", 7)
    assert coded(TEXTS) == [ids_of(t) for t in TEXTS]


def test_small_generations_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 3)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    texts = ["one two three", "three four five one", "two six", "one seven two"] * 2
    own = bpe.Codec(PATH)
    for i in range(0, 8, 2):
        got = [array.array("I", b"".join(p)).tolist() for p in own.encode_batch(texts[i:i + 2])]
        assert got == [ids_of(t) for t in texts[i:i + 2]]


def test_pairs_beside_merging_from_bytes():
    """Two tokens are apart just where the tokenizer leaves them apart."""
    c = bpe.codec(PATH)
    tokens = [i for i in range(0, 50000, 271) if c.bytes_of[i].isalpha()]
    for a in tokens:
        for b in tokens[::7]:
            text = (c.bytes_of[a] + c.bytes_of[b]).decode()
            assert c.apart(a, b) == (ids_of(text) == [a, b])


def test_characters_are_split_as_by_the_library():
    c = bpe.codec(PATH)
    for cp in [*range(0x3100), *range(0x3100, 0x110000, 61)]:
        if unicodedata.category(chr(cp)) != "Cs":
            text = f"a{chr(cp)}1{chr(cp)}! {chr(cp)} 's"
            assert c.words(text) == [text[a:b] for _, (a, b) in PLAIN.pre_tokenizer.pre_tokenize_str(text)], hex(cp)


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, TEXTS[3], "y"), (99, "long words all over " * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, PATH).collect()}
    want = set()
    for i, t, _ in rows:
        ids = ids_of(t or "")
        text = PLAIN.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == want


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, PATH, with_ids=True), PATH).select("doc_id", "text")
    assert back.exceptAll(docs).isEmpty() and docs.exceptAll(back).isEmpty()


@pytest.mark.parametrize("ids", [[128, 129], [162, 120, 95, 126], [50256, 220]])
def test_decoding_ids_that_are_no_whole_characters(ids):
    got = bpe.codec(PATH).decode(array.array("I", ids).tobytes()).decode("utf-8", "replace")
    assert got == PLAIN.decode(ids, skip_special_tokens=False)
