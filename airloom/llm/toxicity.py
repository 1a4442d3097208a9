"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Folding lower-cases, maps look-alike letters of other alphabets and full-width
forms to Latin ones, digits and signs that stand for letters to these letters,
and punctuation to blanks. Lexicon entries are word beginnings. They are learned
from at most ``MAX_LABELS`` labelled rows (those with the least hash of their
id): all beginnings of 4 to 10 letters in ``MIN_TEXTS`` toxic texts with log odds of toxic
against other texts, their weight, of ``MIN_WEIGHT`` or more. Of a chain of beginnings the longest that
keeps ``KEEP`` of the toxic texts of the chain's first stands for it; the good branches beside it,
and a good word that ends there (with a blank as its last letter), are entries of their own. Hits inside an exception phrase do not count.

A text's score is a logistic function, fitted on the same rows, of the weight of its
hits per 100 words and of the logarithm of that weight and of its length. Without
toxic labels the score is 0.

A null text is empty; it has no hits and gets the score of its length. Null ids
are never labelled; repeated ids count once with their largest label; repeated
rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.classifier import labelled_sample, labels_of
from airloom.llm.common import bytes_of, crc_mod, documents, prepare_workers, stage

MAX_LABELS = 50_000
#: Least number of toxic texts of a lexicon entry, at every size.
MIN_TEXTS = 3
HELD = 200_000
LENGTHS = range(4, 11)
MIN_WEIGHT = 2.5
KEEP = 0.8
THRESHOLD = 0.3
#: Harmless phrases around words that are often meant as insults.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown nose", "circus clown", "pond scum", "soap scum")

# Look-alike letters and what they look like, then signs and digits for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ѵ": "v",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e"}
FOLD = str.maketrans(
    LOOK_ALIKE | SIGNS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys("​‌‍­", "")
    | dict.fromkeys(".,;:!?\"'()[]{}|#%&*_-/\\<>+=~^`\n\t\r\x0b\x0c", " ")
)


def folded(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").lower().translate(FOLD).split()


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {phrase}", (len(phrase) + 1, None, 0))
        for entry, w in self.weights.items():
            if f" {entry}" not in found:
                found.add_word(f" {entry}", (len(entry) + 1, w, int(entry.endswith(" "))))
        found.make_automaton()
        return found


_AUTOMATA: dict[int, tuple[Lexicon, ahocorasick.Automaton]] = {}


def hits(text: bytes, lexicon: Lexicon) -> tuple[float, int]:
    """The weight of a text's hits, and its number of words."""
    held = _AUTOMATA.get(id(lexicon))
    if held is None or held[0] is not lexicon:
        _AUTOMATA.clear()
        held = _AUTOMATA[id(lexicon)] = (lexicon, lexicon.automaton())
    words = folded(text)
    total, spared = [], []
    if len(held[1]):
        for end, (length, w, blank) in held[1].iter(" " + " ".join(words) + " "):
            (spared if w is None else total).append((end - length + 1, end - blank, w))
    inside = lambda a: any(s[0] <= a[0] and a[1] <= s[1] for s in spared)
    return sum(t[2] for t in total if not (spared and inside(t))), len(words)


def beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's counts of toxic and clean texts by word beginning, handed on in parts so that few are held at a time."""
    seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()

    def part() -> pd.DataFrame:
        rows = [(e, seen[1][e], seen[0][e]) for e in seen[0].keys() | seen[1].keys()]
        return pd.DataFrame(rows, columns=["entry", "toxic", "clean"]).astype({"entry": str, "toxic": "int64", "clean": "int64"})

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            seen[bool(toxic)].update({f"{w} "[:n] for w in set(folded(text)) if len(w) >= LENGTHS[0] for n in LENGTHS if len(w) + 1 >= n})
        if len(seen[0]) + len(seen[1]) > HELD:
            yield part()
            seen = Counter(), Counter()
    yield part()


def learned_lexicon(texts: DataFrame) -> dict[str, float]:
    """Entries and weights from ``text`` and ``toxic``."""
    sizes = {bool(t): n for t, n in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic:
        return {}
    counts = texts.select("text", "toxic").mapInPandas(beginnings, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    good = counts.filter(F.col("toxic") >= MIN_TEXTS).withColumn("weight", odds).filter(F.col("weight") >= MIN_WEIGHT)
    rows = good.select("entry", "toxic", "weight").collect()  # of MAX_LABELS labels
    toxic, weight = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    return chosen(toxic, weight)


def chosen(toxic: dict[str, int], weight: dict[str, float]) -> dict[str, float]:
    """Of all good beginnings the entries; every good beginning has an entry as its beginning, or is parted into entries."""
    nearest: dict[str, list[str]] = {}
    todo: list[tuple[str, int]] = []
    for e in sorted(weight):
        above = next((e[:n] for n in range(len(e) - 1, LENGTHS[0] - 1, -1) if e[:n] in weight), None)
        if above is None:
            todo.append((e, toxic[e]))  # with the count that its chain began with
        else:
            nearest.setdefault(above, []).append(e)
    out = {}
    while todo:
        e, first = todo.pop()
        longer = [x for x in nearest.get(e, ()) if not x.endswith(" ")]  # a whole word alone would lose its other endings
        main = max(longer, key=toxic.get, default=None)
        if main is None or toxic[main] < KEEP * first:
            out[e] = weight[e]
        else:
            todo += [(x, first if x == main else toxic[x]) for x in nearest[e]]
    return out


def inputs(weight, words) -> np.ndarray:
    weight, words = np.asarray(weight, float), np.asarray(words, float)
    return np.column_stack([np.ones(len(weight)), 100 * weight / np.maximum(words, 1), np.log1p(weight), np.log1p(words)])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def weigher(lexicon: Lexicon):
    @F.pandas_udf("weight double, words long")
    def weigh(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(t, lexicon) for t in text], columns=["weight", "words"])

    return weigh


def scored(df: DataFrame, labels: DataFrame, training: Column, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """Adds ``score``, ``hit_weight`` and ``n_words``; learns from labelled rows where ``training`` holds."""
    prepare_workers(df.sparkSession)
    sample = stage(labelled_sample(labels.filter(training), "toxic", MAX_LABELS), "labelled").withColumnRenamed("toxic", "__llm_toxic")
    texts = df.join(F.broadcast(sample), "doc_id").select("doc_id", bytes_of().alias("text"), (F.col("__llm_toxic") == 1).alias("toxic"))
    lexicon = Lexicon(learned_lexicon(texts), exceptions)
    weigh = weigher(lexicon)
    known = texts.select("doc_id", "toxic", weigh("text").alias("w")).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.avg("w.weight").alias("weight"), F.avg("w.words").alias("words"))  # one row for each labelled id
    known = known.toPandas() if lexicon.weights else None
    out = df.withColumn("__llm_w", weigh(bytes_of()))
    out = out.withColumns({"hit_weight": F.col("__llm_w.weight"), "n_words": F.col("__llm_w.words")}).drop("__llm_w")
    if known is None:
        return out.withColumn("score", F.lit(0.0))
    b = fit_logistic(inputs(known["weight"], known["words"]), known["toxic"].to_numpy(float))
    z = F.lit(float(b[0])) + float(b[1]) * 100 * F.col("hit_weight") / F.greatest("n_words", F.lit(1))
    z = z + float(b[2]) * F.log1p("hit_weight") + float(b[3]) * F.log1p(F.col("n_words").cast("double"))
    return out.withColumn("score", 1 / (1 + F.exp(-z)))


def query(spark, sf_dir):
    out = scored(documents(spark, sf_dir).select("doc_id", "text"), labels_of(spark, sf_dir), crc_mod("doc_id", 4) != 2)
    return out.select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
