"""Operators beside brute force, on small tables and on a table of odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from airloom.llm import classifier, exact, language_model, lines, mixing, packing, rules, sharding, simhash
from airloom.llm.common import FILE, ROW, stage, with_row_key
from airloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, `class` string"
ODD = [
    (1, "The same text of a few words here.", "en", "src1", 5, "x", "y", "z"), (1, "The same text of a few words here.", "en", "src1", 5, "x", "y", "z"),
    (2, "THE SAME TEXT OF A FEW WORDS HERE.", "en", None, 5, "x", "y", "z"), (None, None, None, None, None, None, None, None),
    (None, "", "fr", "src2", 0, None, None, None), (3, " \t\n\x0b\f\r", "xx", "src2", 0, None, None, None), (4, "one", "de", "src3", 3, "", "", ""),
    (5, "long words all over " * 20_000, "en", "src4", 9, "k", "s", "c"), (6, "Ünïcode ÄÖÜ línea\nline\nline\n\n", "es", "src5", 9, "k", "s", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    from airloom.session import scratch_path

    folder = scratch_path(spark, "odd")
    spark.createDataFrame(ODD, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.3, -0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, []), (6, [1.0]), (7, [2.0, 7.5])]
    spark.createDataFrame([(i, v, "x", 1.0) for i, v in vectors], "vec_id long, embedding array<float>, n string, whitened double").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark):
    from airloom.session import scratch_path

    folder = scratch_path(spark, "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows(spark, odd, name):
    found = QUERIES[name](spark, odd).collect()
    if name.startswith("op13_"):
        assert len(found) == 8  # four vectors are left, of two components each
    elif not name.startswith(("op1_", "op5_")):
        assert len(found) == len(ODD)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_one_of_each_text_stays(spark, odd):
    rows = QUERIES["op2_exact_dedup"](spark, odd).collect()
    same = [r for r in rows if r.group_size == 3]
    assert len(same) == 3 and {r.keep_id for r in same} == {2} and sum(r.kept for r in same) == 1
    assert sum(r.kept for r in rows) == len({(r[1] or "").lower() for r in ODD})
    left = exact.drop_copies(spark.read.parquet(f"{odd}/documents.parquet"))
    assert left.columns == [f.split()[0].strip("`") for f in SCHEMA.split(", ")] and left.count() == sum(r.kept for r in rows)


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 100, 5000):
        values = np.unique(rng.integers(0, 2**59, n, dtype=np.uint64) + np.uint64(5 << 59))
        k, bits = exact.rice_encode(values, 5 << 59)
        assert (exact.rice_decode(len(values), k, bits, 5 << 59) == values).all()
    k, bits = exact.rice_encode(values, 5 << 59)
    assert len(bits) < 7.5 * len(values)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    p = sharding.Permutation(n)
    places = [p.of(i) for i in range(n)]
    assert sorted(places) == list(range(n)) and all(p.row_of(x) == i for i, x in enumerate(places))


def test_shards(spark, docs):
    rows = sharding.shard(docs.select("doc_id"), 16).collect()
    p = sharding.Permutation(len(rows))
    assert all(r.position == p.of(r.row_number) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    filtered = docs.filter("doc_id % 3 = 0").select("doc_id")
    assert sorted(r.row_number for r in sharding.shard(filtered).collect()) == list(range(filtered.count()))


def strict_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_beside_all_pairs(spark, docs):
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text) < 4000]
    rng = random.Random(3)
    rows = list(base)
    for i, (d, t) in enumerate(base[:40]):  # chains of texts that differ in a word
        for j in range(4):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
            rows.append((10_000 + 10 * i + j, t))
    frame = stage(spark.createDataFrame(rows, "doc_id long, text string"), "near")
    found = {r.doc_id: r for r in simhash.groups(with_row_key(frame)).collect()}
    fps = {d: strict_fingerprint(t) for d, t in rows}
    assert {d: r.fp % 2**64 for d, r in found.items()} == fps
    root = {d: d for d in fps}
    for _ in range(len(fps)):
        new = {d: min(root[e] for e in fps if (fps[d] ^ fps[e]).bit_count() <= 2) for d in fps}
        if new == root:
            break
        root = new
    assert {d: r.component_id for d, r in found.items()} == root
    assert sum(r.kept for r in found.values()) == len(set(root.values())) < len(rows)


def test_large_keys_are_cut_again(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 8)
    values = np.unique(np.random.default_rng(2).integers(0, 2**9, 200, dtype=np.uint64))
    edges = simhash.spanning(values, 2**64 - 1, 2)
    group = {int(v): {int(v)} for v in values}
    for a, b in edges:
        joined = group[a] | group[b]
        for x in joined:
            group[x] = joined
    left, seen = set(map(int, values)), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            x = todo.pop()
            comp.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        seen.append(comp)
    assert sorted(map(sorted, seen)) == sorted(sorted(g) for g in {frozenset(g) for g in group.values()})


def test_repeated_windows_beside_sets(spark, docs, odd):
    for frame in (docs, spark.read.parquet(f"{odd}/documents.parquet").filter("doc_id <> 5")):
        for r in rules.counts(frame.select("lang", "text", "doc_id")).collect():
            text = r.text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            windows = defaultdict(list)
            for i in range(len(words) - 7):
                windows[tuple(words[i:i + 8])].append(i)
            held = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
            told = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.n_symbols) == (
                len(words), sum(map(len, words)), len(held), len(told) - len(set(told)), sum(text.count(c) for c in "#*$%&|<>"))


def test_language_model_sums_to_one(spark, docs):
    model = language_model.fit(docs.limit(60).select("text"), owners=3)
    words = np.unique(np.concatenate([np.asarray(a) for a in model.arrays("words") if a is not None]))
    for context in (words[0], words[len(words) // 2], np.uint64(language_model.START), np.uint64(12345)):
        logs = model.logs(np.full(len(words) + 1, context), np.append(words, np.uint64(99)))[0]
        assert abs(np.sum(10**logs) - 1) < 1e-9


@pytest.mark.parametrize("harm", ["gone", "short"])
def test_language_model_with_a_missing_file_raises(spark, docs, harm):
    """A worker that does not see the model must fail, not score."""
    import glob
    import os

    model = language_model.fit(docs.limit(60).select("text"), owners=3)
    path = sorted(glob.glob(f"{model.folder}/*-keys.npy"))[1]
    if harm == "gone":
        os.replace(path, f"{path}.away")
    else:
        np.save(path, np.load(path)[:-1])
    words = language_model.tokens([b"the cat sat on it"])
    with pytest.raises(OSError):
        model.logs(words[0], words[1])


def test_language_model_beats_its_base(spark):
    rows = [r for r in QUERIES["op6_kneser_ney"](spark, SF).collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    train, tokens = Counter(), {d: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [b"\n"] for d, t in texts.items()}
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            train.update(t)
    n, v = sum(train.values()), len(train)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in train for w in t), n)
        assert abs(r.base_score - sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6 * len(t)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_kth_largest(spark):
    values = [random.Random(i).randrange(2**48) for i in range(500)] + [7] * 5
    frame = spark.createDataFrame([(v,) for v in values], "place long")
    for k in (1, 250, 501, 505):
        assert classifier.kth_largest(frame, k) == sorted(values, reverse=True)[k - 1]


def test_classifier_keeps_good_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = {r.doc_id: r.kept for r in QUERIES["op8_importance_resampling"](spark, "/root/testdata/sf0.01").collect()}
    good, bad = [found[d] for d, q in labels.items() if q == 1], [found[d] for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_shares_fill_siblings_first(spark):
    sizes = spark.createDataFrame([("web", "en", "a", 10, 1), ("web", "de", "b", 1000, 1), ("books", "en", "c", 1000, 1)], "domain string, lang string, source string, size long, n_rows long")
    from pyspark.sql import functions as F

    found = {r.source: r.budget for r in mixing.plan(sizes, F.lit(700.0), {"web": 4.0, "books": 3.0}, {"en": 1.0, "de": 1.0}, 1).collect()}
    assert found == {"a": 10, "b": 390, "c": 300}  # the sibling takes what is short, not the other domain


@pytest.mark.parametrize("domains, langs, want", [
    ({"web": 0.0, "books": 3.0}, {"en": 1.0, "de": 1.0}, {"a": 0, "b": 0, "c": 300}),  # the sibling takes it
    ({"web": 4.0, "books": 3.0}, {"en": 0.0, "de": 1.0}, {"a": 0, "b": 400, "c": 0}),  # books has English alone: nothing there
    ({"web": 0.0, "books": 0.0}, {"en": 1.0, "de": 1.0}, {"a": 0, "b": 0, "c": 0}),
])
def test_weight_zero_excludes(spark, domains, langs, want):
    sizes = spark.createDataFrame(
        [("web", "en", "a", 10, 1), ("web", "de", "b", 1000, 1), ("books", "en", "c", 300, 1)], "domain string, lang string, source string, size long, n_rows long")
    found = {r.source: r.budget for r in mixing.plan(sizes, F.lit(700.0 if domains["web"] == 0 else 400.0), domains, langs, 1).collect()}
    assert found == want


def test_excluded_sources_have_no_rows(spark, docs):
    names = {mixing.DOMAINS[zlib.crc32(f"src{i}".encode()) % 4]: f"src{i}" for i in range(20)}
    out = mixing.mix(docs, domain_weights={"web": 0.0, "books": 1.0, "news": 1.0, "forum": 1.0}).select("domain").distinct().collect()
    assert names and {r.domain for r in out} <= {"books", "news", "forum"}


def test_lines_keep_their_order(spark):
    rows = [(i, f"own {i}\n Shared \nlast {i}") for i in range(12)] + [(99, "shared\n\nSHARED\nx")]
    found = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3] == "own 3\nlast 3" and found[99] == "\nx"


def test_lines_meet_their_texts_alike_at_every_size(spark):
    """A broadcast for few dropped lines and a shuffle for many would be two plans."""
    rows = [(i, f"common\nown {i}") for i in range(12)]
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.kept_text for r in kept.collect()} == {f"own {i}" for i in range(12)}


def test_keys_tell_rows_apart(spark, odd):
    keyed = with_row_key(spark.read.parquet(f"{odd}/documents.parquet"))
    assert keyed.select(FILE, ROW).distinct().count() == len(ODD)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, f in p.STAGES[:3]:
        docs = stage(f(spark, docs, SF), name)
        assert docs.columns == p.COLUMNS and 0 < docs.count() <= before
        before = docs.count()
    texts = [r.text.lower() for r in docs.collect()]
    assert len(texts) == len(set(texts))
    mixed = stage(p.STAGES[3][1](spark, docs, SF), "mixed")
    packed = p.STAGES[4][1](spark, mixed, SF)
    assert packed.filter("start = 0").count() == mixed.count() and packing.CAPACITY >= packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
