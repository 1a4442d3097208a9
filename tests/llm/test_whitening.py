"""Whitening beside a plain numpy version over all rows."""

import math

import numpy as np
import pytest

from airloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, w int"


def plain(rows, components=8):
    """vec_id, exact deviation and whitened vector of each row, and the eigenvalues' shares."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n, sums = len(xs), [sum(col) for col in zip(*xs)]
    dev = [sum((n * x - s) ** 2 for x, s in zip(v, sums)) for v in xs]
    c = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for v in xs])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in kept], dev, c @ vectors[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)


def check(found, rows, components=8):
    ids, dev, white, shares = plain(rows, components)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(ids) * white.shape[1] and set(by_id) == set(ids)
    signs = np.sign([by_id[ids[0]][k + 1].whitened * white[0, k] for k in range(white.shape[1])])
    for i, d, w in zip(ids, dev, white):
        for k in range(white.shape[1]):
            r = by_id[i][k + 1]
            assert r.n == len(ids) and r.deviation == (d if d < 2**63 else None)
            assert r.whitened == pytest.approx(w[k] * signs[k], abs=1e-8)
            assert r.explained == pytest.approx(shares[k], rel=1e-9) and r.identity_error < 1e-9


def random_rows(n, d, seed=7):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) * np.linspace(0.1, 2, d)).astype(np.float32).tolist()) for i in range(n)]


def test_beside_numpy(spark):
    rows = random_rows(300, 12)
    check(whitening.whiten(table(spark, rows)).collect(), rows)


def test_repeated_vectors_and_bad_rows(spark):
    rows = random_rows(60, 5)
    rows += [(100 + i, rows[0][1]) for i in range(200)] + [(400, None), (401, [None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 5), (403, [float("inf")] + [0.0] * 4), (404, [])]
    check(whitening.whiten(table(spark, rows)).collect(), rows)


def test_small_fixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_far_entries_stay_exact(spark):
    """Entries of several widths; the deviations pass a long."""
    rows = [(i, [c * 3e6 if i % 2 else c for c in v]) for i, v in random_rows(40, 3)]
    check(whitening.whiten(table(spark, rows)).collect(), rows)
    assert any(d >= 2**63 for d in plain(rows)[1])


def test_weight_one_fits_on_distinct_vectors(spark):
    rows = random_rows(50, 4)
    copies = rows + [(1000 + i, rows[3][1]) for i in range(70)]
    found = [r for r in whitening.whiten(table(spark, copies), weights="one").collect() if r.vec_id < 1000]
    check(found, rows)
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, rows), weights="two")


def test_no_variance(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in found)
    found = whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 1.25]), (2, [0.5, 1.25])])).collect()
    assert sorted((r.component, r.whitened is None) for r in found) == [(1, False)] * 3 + [(2, True)] * 3
    assert {r.explained for r in found if r.component == 1} == {1.0} and all(r.identity_error < 1e-9 for r in found)


def test_other_lengths_are_dropped(spark):
    rows = random_rows(30, 3)
    found = whitening.whiten(table(spark, [*rows, (900, [1.0]), (901, [1.0, 2.0])])).collect()
    check(found, rows)


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("vector", [[0.0], [31.9, -32.0], [32.0], [1e6, -1e9], [-0.001]])
def test_packing(vector):
    assert whitening.unpack(whitening.pack(vector)).tolist() == [math.floor(1024 * c) + 100000 for c in vector]
