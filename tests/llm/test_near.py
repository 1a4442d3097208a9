"""The pipeline's near copies beside all pairs in plain Python."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airloom.llm import near, simhash
from airloom.llm.common import stage, with_row_key


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))}


def roots(sets):
    """The smallest id of everyone's group, by all pairs."""
    root = {d: d for d in sets}
    for d in sets:
        for e in sets:
            if e < d and root[d] != root[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                old, new = max(root[d], root[e]), min(root[d], root[e])
                root = {x: new if r == old else r for x, r in root.items()}
    return root


@pytest.mark.parametrize("cell", [near.CELL, 7])
def test_stage_beside_all_pairs(spark, monkeypatch, cell):
    """With small cells, circles go key by key and keys are cut."""
    monkeypatch.setattr(near, "CELL", cell)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(corpus_pipeline.COLUMNS).collect()
    rng, rows = random.Random(5), [tuple(r) for r in docs if len(r.text) < 4000][:120]
    for i, r in enumerate(rows[:60]):  # chains of texts, each with a few words of the one before changed
        text = r[1]
        for j in range(3):
            words = text.split()
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = f"changed{j}"
            text = " ".join(words)
            rows.append((1_000_000 + 10 * i + j, text, *r[2:]))
    passage = " ".join(f"common{i}" for i in range(60))
    rows += [(2_000_000 + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(20 + i)), *rows[0][2:]) for i in range(30)]
    rows += [(3_000_000, None, *rows[0][2:]), (3_000_001, " \t\n", *rows[0][2:]), (3_000_002, "one two", *rows[0][2:]), (3_000_003, "One  TWO", *rows[0][2:])]
    frame = stage(spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(corpus_pipeline.COLUMNS).schema), "near")
    want = roots({r[0]: shingles(r[1]) for r in rows})
    found = corpus_pipeline.near_dedup(spark, frame, "").collect()
    assert sorted(r.doc_id for r in found) == sorted(set(want.values()))
    assert len(found) < len(rows) - 40


@pytest.mark.parametrize("cell", [near.CELL, 2])
def test_fingerprints_bring_candidates_and_similarity_decides(spark, monkeypatch, cell):
    """Without MinHash keys, SimHash alone brings texts together; groups that are not similar stay apart."""
    monkeypatch.setattr(near, "CELL", cell)
    sketcher = near.sketcher

    def without_keys(shingle):
        return lambda text: F.struct(sketcher(shingle)(text)["node"].alias("node"), F.array().cast("array<long>").alias("keys"))

    monkeypatch.setattr(near, "sketcher", without_keys)
    words = [f"w{i}" for i in range(2000)]
    changed = [*words[:1000], "other", *words[1001:]]
    much = ["same", "few", "words"] * 400  # one fingerprint, but no similarity of the distinct shingles
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(changed).upper()), (4, None)]
    rows += [(10 + i, " ".join([*much, *(f"own{i}x{j}" for j in range(20))])) for i in range(3)]
    frame = stage(spark.createDataFrame(rows, "doc_id long, text string"), "near")
    fps = {r[0]: simhash.fingerprint_of((r[1] or "").encode()) for r in rows}
    assert (fps[1] ^ fps[2]).bit_count() <= 2 and (fps[10] ^ fps[11]).bit_count() <= 2
    found = near.groups(with_row_key(frame)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 10: 10, 11: 11, 12: 12}


def test_spanning_forest_of_similar_sets():
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 2**63, 100, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(base[i % 4], 92, replace=False), rng.integers(0, 2**63, i % 9, dtype=np.uint64)])) for i in range(80)]
    edges, root = near.linked(sets), list(range(len(sets)))
    assert len(edges) < len(sets)
    for a, b in edges:
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
        root = [root[a] if r == root[b] else r for r in root]
    want = roots({i: set(map(int, s)) for i, s in enumerate(sets)})
    assert [min(j for j in range(len(sets)) if root[j] == root[i]) for i in range(len(sets))] == list(want.values())


def test_readers_of_a_template_are_not_compared_pair_by_pair():
    """250 of 310 shingles in common are a similarity of 0.68; the place of the first common one says so."""
    rng, template = np.random.default_rng(1), np.random.default_rng(2).integers(0, 2**63, 250, dtype=np.uint64)
    sets = [np.unique(np.concatenate([template, rng.integers(0, 2**63, 60 + i % 3, dtype=np.uint64)])) for i in range(4000)]
    start = time.process_time()
    assert near.linked(sets) == []
    assert time.process_time() - start < 20  # with every pair compared it takes over a minute
