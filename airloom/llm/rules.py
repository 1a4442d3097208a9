"""Quality rules by divergence of distributions.

Base rules first: a text fails with fewer than ``MIN_WORDS`` words, or when over
``REPEAT_PERCENT`` of its words lie in windows of 8 words that occur twice or more.

Then two histograms of every text are compared with references of its language
by the Jensen-Shannon distance (square root of the divergence to base 2, so 0
to 1): classes of characters (small letters, capitals, digits, white space,
punctuation, symbols) and common words (one bin for each word of a short list,
one for all other words). A language's reference is the sum of the histograms
of its texts that pass the base rules, taken twice: the second time without texts
that are too far from the first sum. Guards: a text is compared only from
``MIN_CLASS_CHARS`` characters or ``MIN_COMMON_WORDS`` words on; a language
without a list is compared by classes only; a language without reference by neither.

A null text is empty and fails for its length; a null language is a language of
its own; repeated rows do not matter; an empty table gives an empty result. Result
columns replace columns of the same name.

Texts are read once, counts of each row are written to the shared folder, and
the references are sums over those. All work on a text stays in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import FILE, ROW, documents, stage, text_of, with_row_key, words_of

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 120
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.26

# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on",
    "de": "der die und in den von zu das mit sich des auf für ist im dem",
    "fr": "de la le et les des en un du une que est pour qui dans par",
    "es": "de la que el en y a los del se las por un para con una",
}
PUNCTUATION = "[.,;:!?'\"()\\-]"
CLASSES = ["small", "capitals", "digits", "spaces", "marks", "symbols"]


def covered_words(hashes: str, n_words: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more, from the windows' hashes in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(p: Column) -> Column:
        near = F.transform(p, lambda x, j: F.when(
            (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.filter(near, lambda i: i.isNotNull()))

    # A one-element array is a place to keep the sorted pairs while a lambda looks at them.
    starts = F.flatten(F.transform(F.array(pairs), again))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(starts, none, lambda s, i: F.struct(
        (s["n"] + i + WINDOW - F.greatest(s["end"], i.cast("long"))).alias("n"), (i + WINDOW).cast("long").alias("end")
    ), lambda s: s["n"])


def counts(df: DataFrame) -> DataFrame:
    """Adds the base counts, ``classes`` and ``common`` to rows; ``common`` is null without a list."""
    out = df.withColumn("__llm_text", text_of()).withColumn("__llm_words", words_of(F.col("__llm_text")))
    n = F.size("__llm_words")
    text = F.col("__llm_text")
    out = out.withColumns({
        "n_words": n.cast("long"),
        "__llm_joined": F.concat(F.lit(" "), F.array_join("__llm_words", "  "), F.lit(" ")),
        "__llm_hashes": F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("__llm_words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "__llm_lines": F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(" \t\x0b\f\r")) != ""),
    })
    lists = F.create_map(*[x for lang, words in COMMON.items() for x in (F.lit(lang), F.array(*map(F.lit, words.split())))])
    joined = F.col("__llm_joined")
    # Words stand between two blanks each, so neighbours do not share one.
    found = lambda w: ((F.length(joined) - F.length(F.replace(joined, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("long")
    out = out.withColumns({
        "word_chars": (F.length("__llm_joined") - F.greatest(2 * F.col("n_words"), F.lit(2))).cast("long"),
        "n_dup_lines": (F.size("__llm_lines") - F.size(F.array_distinct("__llm_lines"))).cast("long"),
        "n_repeat_words": F.when(
            F.size(F.array_distinct("__llm_hashes")) == F.size("__llm_hashes"), F.lit(0).cast("long")
        ).otherwise(covered_words("__llm_hashes", n)),
        "__llm_upper": F.regexp_count(text, F.lit("\\p{Lu}")), "__llm_digits": F.regexp_count(text, F.lit("\\p{Nd}")),
        "__llm_marks": F.regexp_count(text, F.lit(PUNCTUATION)),
        "__llm_other": F.regexp_count(text, F.lit("[^\\p{L}\\p{M}\\p{Nd}\\x20\\x09-\\x0D.,;:!?'\"()\\-]")),
        "common": F.transform(F.get(F.array(F.element_at(lists, F.coalesce("lang", F.lit("")))), F.lit(0)), found),
    })
    spaces = F.length(text) - F.col("word_chars")
    rest = F.col("word_chars") - F.col("__llm_upper") - F.col("__llm_digits") - F.col("__llm_marks") - F.col("__llm_other")
    out = out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "classes": F.array(*[c.cast("long") for c in (
            rest, F.col("__llm_upper"), F.col("__llm_digits"), spaces, F.col("__llm_marks"), F.col("__llm_other"))]),
        "common": F.when(F.col("common").isNotNull(), F.concat(
            F.array((F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)).cast("long")), F.col("common"))),
    })
    return out.drop(*[c for c in out.columns if c.startswith("__llm_") and c not in (FILE, ROW)])


def summed(c: str, n: int) -> Column:
    return F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])


def references(counted: DataFrame) -> DataFrame:
    """For every language the sums over its texts that pass the base rules, taken again without the texts far from the first sums."""
    first = stage(summed_by_lang(counted), "first_references")
    return summed_by_lang(judge(counted, first).filter("kept"))


def summed_by_lang(counted: DataFrame) -> DataFrame:
    bins = 1 + max(len(w.split()) for w in COMMON.values())
    good = counted.filter("NOT base_failed").withColumn("lang", F.coalesce("lang", F.lit("")))
    return good.groupBy("lang").agg(summed("classes", len(CLASSES)).alias("ref_classes"), summed("common", bins).alias("ref_common"))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null where one of them is missing or empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    share = F.zip_with(p, q, lambda x, y: F.struct((x / total(p)).alias("x"), (y / total(q)).alias("y")))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.aggregate(share, F.lit(0.0), lambda a, s: a + term(s["x"], (s["x"] + s["y"]) / 2) + term(s["y"], (s["x"] + s["y"]) / 2))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(parts / 2, F.lit(0.0))))


def judge(counted: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``class_distance``, ``word_distance`` and ``kept``."""
    refs = refs.withColumnRenamed("lang", "__llm_lang")
    out = counted.withColumn("__llm_lang", F.coalesce("lang", F.lit(""))).join(refs, "__llm_lang", "left").drop("__llm_lang")
    long_enough = (F.col("word_chars") >= MIN_CLASS_CHARS, F.col("n_words") >= MIN_COMMON_WORDS)
    out = out.withColumns({
        "class_distance": F.when(long_enough[0], distance("classes", "ref_classes")),
        "word_distance": F.when(long_enough[1], distance("common", "ref_common")),
    })
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("ref_classes", "ref_common")


def decisions(keyed: DataFrame) -> DataFrame:
    """One narrow row for every row with a key: counts, distances and ``kept``."""
    counted = counts(keyed.select("doc_id", FILE, ROW, "lang", "text")).drop("text")
    counted = stage(counted, "counts")
    return judge(counted, stage(references(counted), "references"))


def drop_bad(df: DataFrame) -> DataFrame:
    keyed = with_row_key(df)
    gone = stage(decisions(keyed).filter("NOT kept").select(FILE, ROW), "dropped")
    return keyed.join(gone, [FILE, ROW], "left_anti").drop(FILE, ROW)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir):
    return decisions(with_row_key(documents(spark, sf_dir))).select("doc_id", *BASE)
