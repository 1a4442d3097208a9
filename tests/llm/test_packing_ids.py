"""Ids beside the plain tokenizer, with its special tokens on."""

import array

import pytest
from tokenizers import Tokenizer

from airloom.llm import packing

PATH = packing.default_tokenizer()
PLAIN = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", [
    "end <|endoftext|> next", "a<|startoftext|>b.<|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>, x", "<|endoftext|", "<|endof text|>",
    "H\u0331ello T\u0308, J\u030c. h\u0331 A\u0301b", "\u00dcber \u00c9COLE na\u00efve, \ufb01n. \u03a3\u0391\u03a3 \u0130x K. CAF\u00c9, it's", "Plain ASCII, don't. STOP", "x\x85Y A\u00a0B", "",
    "I\u0307stanbul \u0130 WORD \u00c9. ANGSTROM \u212b \u1e9e SS A\u030a", "\u03a3\u0391\u03a3 ABC\u03a3 \u03a3x", "\ufb01N \u01c5 \u1f88 \u0149 \u1100\u1161 K\u0327",
])
def test_ids_are_those_of_the_tokenizer(text):
    ids = array.array("I", packing.token_bytes([b"Other words.", text.encode(), b""], PATH)[1]).tolist()
    assert ids == PLAIN.encode(text, add_special_tokens=False).ids + [packing.END]


def test_ids_of_the_small_fixture(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, packing.token_bytes([t.encode() for t in texts], PATH)):
        assert array.array("I", ids).tolist() == PLAIN.encode(text, add_special_tokens=False).ids + [packing.END]
