"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np
import pytest

from ringweave.llm import ann, vector_dedup
from tests.llm.conftest import rows_of


def clustered(spark, n=600, width=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    for i in range(n // 2):
        x[i] = x[r.integers(n // 2, n // 2 + 20)] * r.uniform(0.5, 2) + r.normal(size=width) * r.choice([0.0, 0.2, 0.45])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def brute_links(ids, x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


def test_links_and_components_equal_brute_force(spark):
    x, df = clustered(spark)
    n, label = brute_links(range(len(x)), x)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df, band=100).collect()}
    assert n.sum() > 500
    assert found == {i: (int(n[i]), int(label[i]), bool(label[i] == i)) for i in range(len(x))}


def test_error_bounds_hold():
    x = np.random.default_rng(4).normal(size=(300, 33))
    band = vector_dedup.Band(np.arange(300), np.ones(300, np.int64), x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    guess = (band.codes.astype(float) * band.scale[:, None]) @ (band.codes.astype(float) * band.scale[:, None]).T
    bound = band.rest[:, None] + band.rest[None, :] + np.outer(band.rest, band.rest)
    assert (np.abs(u @ u.T - guess) <= bound + 1e-12).all()


def test_odd_vectors(odd_vectors):
    found = rows_of(vector_dedup.near_vectors(odd_vectors))
    alone = {r[0]: r[1:] for r in found if r[0] in (3, 4, 5, 7, 8, 9, 13)}
    assert alone == {i: (0, i, True) for i in (3, 4, 5, 7, 8, 9, 13)}
    group = [r for r in found if r[2] == 2]
    assert sorted(r[0] or -1 for r in group) == [-1, 2, 6, 10, 14, 100, 100] and {r[1] for r in group} == {6}
    assert [r[0] for r in group if r[3]] == [2]
    assert sorted(r for r in found if r[2] == 0) == [(0, 1, 0, True), (12, 1, 0, False)]
    assert rows_of(vector_dedup.near_vectors(odd_vectors.limit(0))) == []


def brute_near(x, i, k=10):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    return [j for j in np.lexsort((np.arange(len(x)), d)).tolist() if j != i][:k], d


def test_neighbours_and_recall(spark):
    x, df = clustered(spark, 3000, 32, 5)
    found: dict = {}
    for r in ann.neighbours(df, df.where("vec_id % 30 = 0"), bucket=64).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in range(0, 3000, 30):
        want, d = brute_near(x, i)
        got = sorted(found[i])
        assert [g[0] for g in got] == list(range(1, 11))
        assert [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        assert all(g[2] == pytest.approx(d[g[1]], abs=1e-12) for g in got)
        hits += len(set(want) & {g[1] for g in got})
    assert hits / (100 * 10) >= 0.9


@pytest.mark.parametrize("n", [500, 2000])
def test_small_tables_are_answered_by_probes(spark, monkeypatch, n):
    """Buckets of some table are searched, and nothing is left for the comparison with all."""
    seen, search = [], ann.search_blocks

    def watched(placed, *rest):
        seen.append({(r.turn, r.bucket) for r in placed.select("turn", "bucket").distinct().collect()})
        return search(placed, *rest)

    monkeypatch.setattr(ann, "search_blocks", watched)
    x, df = clustered(spark, n, 16, 8)
    found: dict = {}
    for r in ann.neighbours(df, df.where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {i: [v for _, v in sorted(f)] for i, f in found.items()} == {i: brute_near(x, i)[0] for i in range(0, n, 100)}
    keys = np.prod([2 * a for a in ann.axes_for(n, 16)])
    assert len(seen) == 1 and len(seen[0]) == keys and min(seen[0])[0] >= 0


def test_short_answers_are_completed(spark):
    """One probe of one table finds few; the exact search fills up to ten."""
    x, df = clustered(spark, 400, 8, 6)
    found = ann.neighbours(df, df.where("vec_id % 40 = 0"), tables=1, probes=1, bucket=4).collect()
    assert len(found) == 100


def test_recall_holds_with_keys_as_for_millions(spark):
    """6,000 vectors without clusters and buckets of 2: 3,000 keys, as 1.5 million rows have."""
    x = np.random.default_rng(12).normal(size=(6_000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found: dict = {}
    for r in ann.neighbours(df, df.where("vec_id % 200 = 7"), bucket=2).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(found[i] & set(brute_near(x, i)[0])) for i in range(7, 6_000, 200)) / (30 * 10) >= 0.9


def test_probes_grow_with_keys():
    r = np.random.default_rng(3)
    asked = r.normal(size=(60, 32))
    pairs = [(a, a + 1.1 * r.normal(size=(10, 32))) for a in asked]
    plans = [ann.calibrated(pairs, n, 8, 8) for n in (100_000, 1_000_000, 5_000_000)]
    looks = [t * p for t, p in plans]
    assert looks == sorted(looks) and looks[0] >= 64 < looks[-1]
    for n, (tables, probes) in zip((100_000, 1_000_000, 5_000_000), plans, strict=True):
        axes, hits = ann.axes_for(n, 32), []
        for a, near in pairs:
            seen = [set(ann.keys_of(ann.unit(a[None]), t, axes, probes)[0].tolist()) for t in range(tables)]
            own = [ann.keys_of(ann.unit(near), t, axes, 1)[:, 0].tolist() for t in range(tables)]
            hits += [any(own[t][j] in seen[t] for t in range(tables)) for j in range(10)]
        assert np.mean(hits) >= 0.9


def test_hot_vector_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 8))
    x[100:300] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict = {}
    for row in ann.neighbours(df, df.where("vec_id % 10 = 0")).collect():
        found.setdefault(row.query_id, {})[row["rank"]] = row.vec_id
    for i in range(0, 400, 10):
        assert [found[i][k] for k in range(1, 11)] == brute_near(x, i)[0]


def test_odd_neighbours(odd_vectors):
    found = rows_of(ann.neighbours(odd_vectors, odd_vectors.where("vec_id % 100 = 0")))
    assert sorted({r[0] for r in found}) == [0, 100]
    zero = sorted(r for r in found if r[0] == 0)
    assert [(r[1], r[2]) for r in zero] == [(1, 12), (2, 14), (3, 2), (4, 100), (5, 100), (6, None), (7, 6), (8, 10)]
    assert len([r for r in found if r[0] == 100]) == 16
    assert rows_of(ann.neighbours(odd_vectors.limit(0), odd_vectors.limit(0))) == []
