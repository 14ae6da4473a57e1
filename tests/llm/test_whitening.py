"""Whitening against numpy on the whole matrix."""

import numpy as np
import pytest

from ringweave.llm import whitening
from tests.llm.conftest import rows_of


def expected(vectors):
    x = np.floor(np.asarray(vectors, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return ((n * x - s) ** 2).sum(1), centred, values[::-1], axes[:, ::-1]


def check(found, ids, vectors, shown):
    deviation, centred, values, axes = expected(vectors)
    assert len(found) == len(ids) * shown
    at = {i: k for k, i in enumerate(ids)}
    for c in range(1, shown + 1):
        rows = [r for r in found if r.component == c]
        got = np.array([r.whitened for r in sorted(rows, key=lambda r: at[r.vec_id])])
        want = centred @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert all(r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-10) for r in rows)
    assert {(r.vec_id, r.deviation) for r in found} == set(zip(ids, deviation.tolist(), strict=True))
    assert {r.n for r in found} == {len(ids)} and {r.identity_error <= 1e-9 for r in found} == {True}


@pytest.mark.parametrize(("cells", "columns"), [(1 << 18, 1024), (64, 1024), (60, 5)])
def test_whitening_equals_numpy(spark, monkeypatch, cells, columns):
    """One block, many row blocks multiplied in several tasks, and several column blocks."""
    monkeypatch.setattr(whitening, "BLOCK_CELLS", cells)
    monkeypatch.setattr(whitening, "MOST_COLUMNS", columns)
    r = np.random.default_rng(3)
    x = (r.normal(size=(150, 12)) @ r.normal(size=(12, 12))).round(4)
    x[40:60] = x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    check(whitening.whitened(df).collect(), list(range(150)), x, 8)


def test_fewer_dimensions_than_components(spark):
    x = np.random.default_rng(4).normal(size=(30, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    check(whitening.whitened(df).collect(), list(range(30)), x.astype(np.float32), 3)


def test_odd_vectors_whitened(spark, odd_vectors):
    found = whitening.whitened(odd_vectors).collect()
    ids = [100, 2, 4, 6, 8, None, 9, 100, 0, 12, 14]  # null, non-finite and over-long ones gave no rows
    assert sorted(r.vec_id or -1 for r in found) == sorted(i or -1 for i in ids for _ in range(2))
    assert {(r.component, r.n, r.identity_error < 1e-9) for r in found} == {(1, 11, True), (2, 11, True)}
    assert len({(r.component, r.whitened) for r in found if r.vec_id == 100}) == 2


def test_no_variance_and_no_rows(spark, odd_vectors):
    same = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(rows_of(whitening.whitened(same))) == [(i, c, 2, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found = {(r.vec_id, r.component): (r.whitened and abs(r.whitened), r.explained) for r in whitening.whitened(line).collect()}
    assert found == {(1, 1): (1.0, 1.0), (2, 1): (1.0, 1.0), (1, 2): (None, 0.0), (2, 2): (None, 0.0)}
    assert rows_of(whitening.whitened(odd_vectors.limit(0))) == [] == rows_of(whitening.whitened(odd_vectors.where("vec_id = 8")))


def test_deviation_without_long_is_null(spark):
    far = spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")
    assert [(r.deviation, abs(r.whitened)) for r in whitening.whitened(far).collect()] == [(None, 1.0)] * 2
