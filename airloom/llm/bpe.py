"""Byte-level BPE by a trie: distinct words share the encodings of their prefixes.

The encoding of a word's prefix ends in one token, and cutting that token off leaves the encoding of a
shorter prefix. So the last tokens of all prefixes of a word hold its encoding, and words that
begin alike share them. The new words of a batch go into a trie; a depth-first walk passes the last tokens down and
finds each node's only once. A token t ends the prefix p if it is a suffix of p and no merge crosses the border
between t and the last token of p without t.
A word's ids are read off from its end by jumping back a token at a time.

Encodings of words seen lately are kept in two generations; pairs tried are remembered. Both only save work.
Text is cut into words by the tokenizer's own pattern; where it has characters without
a class in Python's Unicode tables, by the tokenizer's pre-tokenizer. Literals of special tokens are
those tokens. Texts are worked through in slabs that end before a space, so a text of any length needs little memory.

A null text is empty: no ids. Decoding joins the bytes of the ids. Repeated rows and ids are rows of their own, other columns
are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from airloom.llm.common import bytes_of, documents, prepare_workers

GENERATION = 400_000
PAIRS = 1_000_000
LONG = 256
SLAB = 2**20
#: A fixed value: the pattern of the vocabulary's words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space after something that is not white space always begins a word.
SLAB_END = re.compile(r"(?<=\S)(?= )")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Trie:
    """Distinct words, front-coded: each one branches off the path to the word before it at some depth.

    In sorted order that is a depth-first walk in which every node (a prefix of some word) is entered once,
    and a long word takes no more than its bytes.
    """

    def __init__(self, words):
        self.words = sorted(words)

    def walk(self) -> Iterator[tuple[int, bytes]]:
        """For each word the depth at which it leaves the one before, and the word."""
        before = b""
        for word in self.words:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            yield depth, word
            before = word


class Merges:
    """The model's merges, asked whether two tokens can stand beside each other in an encoding.

    Merging the bytes of ``left + right`` leaves both tokens whole unless a merge crosses their border. The parts
    that touch the border are the last parts of ``left`` and the first parts of ``right`` from their bytes up; each lives until
    its own token's next merge. Of two merges the one learned earlier goes first, of equal ones the left one.
    """

    NEVER = 2**31

    def __init__(self, merges: list[tuple[int, int, int]], singles: list[int]):
        """``merges``: ids of left part, right part and result, in order; ``singles``: ids of the bytes."""
        self.rank = {}
        made: dict[int, tuple[int, int]] = {}
        for n, (left, right, result) in enumerate(merges):
            self.rank.setdefault((left, right), n)
            made.setdefault(result, (left, right))
        #: For each proper token its first and its last parts, each with the rank of the merge that ends it.
        self.first: dict[int, list[tuple[int, int]]] = {t: [(t, self.NEVER)] for t in singles}
        self.last: dict[int, list[tuple[int, int]]] = {t: [(t, self.NEVER)] for t in singles}
        for token, (left, right) in made.items():
            if left in self.last and right in self.first and token not in self.last and self.crossing(left, right) == (left, right):
                end = self.rank[left, right]
                self.first[token] = [*self.first[left][:-1], (left, end), (token, self.NEVER)]
                self.last[token] = [*self.last[right][:-1], (right, end), (token, self.NEVER)]

    def crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The two parts that are merged across the border of two proper tokens, if any are."""
        lefts, rights, rank = self.last[left], self.first[right], self.rank
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = lefts[i], rights[j]
            n = rank.get((a, b))
            if n is not None and n < a_end and n <= b_end:
                return a, b
            if a_end <= b_end:
                if a_end == self.NEVER:
                    return None
                i += 1
            else:
                j += 1


class Codec:
    """Ids and bytes of one tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet, vocab = byte_alphabet(), model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], [vocab[c] for c in alphabet if c in vocab])
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.size = [len(b) for b in self.bytes_of]
        # The proper tokens by their bytes from the last to the first; 256 marks a token's beginning.
        self.suffixes: dict = {}
        for i in self.merges.last:
            node = self.suffixes
            for b in reversed(self.bytes_of[i]):
                node = node.setdefault(b, {})
            node[256] = i
        self.literals = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pattern = regex.compile(PATTERN)
        self.usual: set[str] = set()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tried: dict[tuple[int, int], bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens can stand beside each other."""
        found = self.tried.get((left, right))
        if found is None:
            if len(self.tried) >= PAIRS:
                self.tried.clear()
            found = self.tried[left, right] = self.merges.crossing(left, right) is None
        return found

    def encode_words(self, words) -> dict[bytes, bytes]:
        """The ids (little-endian, 4 bytes each) of distinct words."""
        last, out, size, suffixes, apart = [-1], {}, self.size, self.suffixes, self.apart
        for depth, word in Trie(words).walk():
            del last[depth + 1:]
            for d in range(depth + 1, len(word) + 1):
                node, fits, at = suffixes, [], d
                while at and (node := node.get(word[at - 1])) is not None:
                    at -= 1
                    if 256 in node:
                        fits.append(node[256])
                for token in reversed(fits):  # exactly one fits
                    before = d - size[token]
                    if not before or apart(last[before], token):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[:d][-64:]!r}")
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            ids.reverse()
            out[word] = array("I", ids).tobytes()
        return out

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            new = set(text) - self.usual
            unassigned = {c for c in new if unicodedata.category(c) == "Cn"}  # libraries may differ on these
            self.usual |= new - unassigned
            if unassigned:
                return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def slabs(self, text: str) -> Iterator[str | int]:
        """Parts of a text in order: special ids, and text between them in slabs."""
        at = 0
        for m in [*self.literals.finditer(text), None]:
            stop = m.start() if m else len(text)
            while at < stop:
                cut = SLAB_END.search(text, at + SLAB, stop) if stop - at > SLAB else None
                end = cut.start() if cut else stop
                yield text[at:end]
                at = end
            if m:
                yield self.special[m.group()]
                at = m.end()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words of a batch; long ones are not kept for the next batch."""
        if len(self.known) > GENERATION:
            self.older, self.known = self.known, {}
        new = words.difference(self.known)
        self.known.update((w, self.older[w]) for w in new.intersection(self.older))
        by_bytes = {w.encode(): w for w in new.difference(self.known)}
        found = {by_bytes[b]: ids for b, ids in self.encode_words(by_bytes).items()}
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= LONG)
        return {w: ids for w, ids in found.items() if len(w) > LONG}

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text, a slab at a time."""
        for part in self.slabs(text):
            if isinstance(part, int):
                yield part.to_bytes(4, "little")
                continue
            words = self.words(part)
            long = self.learn(set(words))
            ids = self.known.__getitem__ if not long else (lambda w: long[w] if w in long else self.known[w])
            yield b"".join(map(ids, words))

    def encode_batch(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """As ``encode``, for each of some texts; the new words of short texts go into one trie."""
        short = [t for t in texts if len(t) <= SLAB and not self.literals.search(t)]
        words = [self.words(t) for t in short]
        long = self.learn(set().union(*words))
        ids = self.known.__getitem__ if not long else (lambda w: long[w] if w in long else self.known[w])
        ready = iter([b"".join(map(ids, w)) for w in words])
        for t in texts:
            yield iter([next(ready)]) if len(t) <= SLAB and not self.literals.search(t) else self.encode(t)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def coder(path: str, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out: list[tuple] = []
            texts = [t.decode("utf-8", "replace") for t in batch["text"].to_pylist()]
            for doc, parts in zip(batch["doc_id"].to_pylist(), c.encode_batch(texts)):
                n, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in parts:  # parts end with whole characters
                    n += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(c.decode(ids).decode("utf-8", "replace").encode())
                    if with_ids:
                        kept.append(ids)
                out.append((doc, n, ids_hash.hexdigest(), text_hash.hexdigest()) + ((b"".join(kept),) if with_ids else ()))
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(columns, schema)], schema=schema)

    return run


def encode(df: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and ``ids`` (4 bytes each) on request."""
    prepare_workers(df.sparkSession)
    kind = df.schema["doc_id"].dataType
    told = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    arrow = pa.schema([
        ("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
        *([("ids", pa.binary())] if with_ids else []),
    ])
    return df.select("doc_id", bytes_of().alias("text")).mapInArrow(coder(tokenizer, with_ids, arrow), told)


def decode(df: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """``df`` with ``text``, the decoded ids of a binary column; a null stays null."""
    prepare_workers(df.sparkSession)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        c = codec(tokenizer)
        return pd.Series([None if i is None else c.decode(i).decode("utf-8", "replace") for i in ids], dtype=object)

    return df.withColumn("text", text(column))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir):
    return encode(documents(spark, sf_dir).select("doc_id", "text"), default_tokenizer())
