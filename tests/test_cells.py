"""Pruned joins and searches against all pairs: same rows, fewer comparisons."""

import numpy as np
import pytest

from kindred.operators import cells, pairs, quantizer

SHAPES = {"clusters": (40, 0.25), "one cluster and noise": (1, 0.25), "no clusters": (0, 1.0)}


def table(kind, n=3000, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    many, width = SHAPES[kind]
    noise = rng.normal(size=(n, dim))
    if not many:
        x = noise
    else:
        near = n if kind == "clusters" else n // 2
        x = np.concatenate([rng.normal(size=(many, dim))[rng.integers(0, many, near)] + width * noise[:near] / 2, noise[near:]])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")


@pytest.mark.parametrize("kind", SHAPES)
@pytest.mark.parametrize("threshold", [0.02, 1.2])
def test_pruned_pairs_equal_all_pairs(spark, monkeypatch, kind, threshold):
    monkeypatch.setattr(pairs, "ROW_COST", 1.0)
    monkeypatch.setattr(pairs, "BLOCK_COST", 1.0)
    x = table(kind, 1200)
    x[::7] *= 1.5  # vectors that are no unit vectors count by their products
    x[::11] *= 0.6
    d = 1 - x @ x.T
    got = pairs.pairs_within(frame(spark, x), threshold, block=100)
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == [(i, j) for i, j in np.argwhere(d < threshold).tolist() if i < j]


def test_clusters_are_compared_with_few_others(spark, monkeypatch):
    x = table("clusters", 6000)
    df = frame(spark, x)
    r = pairs.compared_pairs(df, 0.05, block=200).first()
    assert r.vectors == 6000 and r.pairs == 6000 * 5999 // 2 and r.compared <= r.pairs and r.share < 0.2
    assert pairs.compared_pairs(df, 0.05).first().share == 1.0  # one block
    assert pairs.compared_pairs(df.limit(0), 0.05).first().share == 0.0


@pytest.mark.parametrize("kind", SHAPES)
def test_pruned_search_equals_all_distances(spark, monkeypatch, kind):
    monkeypatch.setattr(pairs, "ROW_COST", 1.0)
    monkeypatch.setattr(pairs, "BLOCK_COST", 1.0)
    x = table(kind, 1000)
    x[500:520] = x[0]  # ties
    df = frame(spark, x)
    found, work = pairs.top_k_plan(df.where("item_id % 3 = 0"), df, 4, block=100)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    got = sorted((r.query_id, r["rank"], round(r.dist, 9)) for r in found.collect())
    want = sorted((q, k + 1, round(v, 9)) for q in range(0, 1000, 3) for k, v in enumerate(np.sort(d[q])[:4]))
    assert got == want and work <= 1.2 * 334 * 1000
    if kind == "clusters":
        assert work < 0.5 * 334 * 1000


@pytest.mark.parametrize("kind", SHAPES)
def test_pruned_code_search_equals_the_whole_scan(spark, monkeypatch, kind):
    x = table(kind, 700)
    df = frame(spark, x)
    book = quantizer.first_rows_codebook(df, 4, 32, 16)
    codes = quantizer.encode(df, book)
    want, all_ = quantizer.adc_search(df.where("item_id % 5 = 0"), codes, book, 5)
    monkeypatch.setattr(pairs, "ROW_COST", 1.0)
    monkeypatch.setattr(pairs, "BLOCK_COST", 1.0)
    got, work = quantizer.adc_search(df.where("item_id % 5 = 0"), codes, book, 5, block=100)
    key = lambda r: (r.query_id, r["rank"], r.item_id, r.dist)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and all_ == 140 * 700
    if kind == "no clusters":
        return
    near, fewer = quantizer.adc_search(df.where("item_id % 5 = 0"), codes, book, 5, block=100, within=0.2)
    assert {key(r) for r in want.where("dist <= 0.2").collect()} == {key(r) for r in near.where("dist <= 0.2").collect()} and fewer <= work + 140 * 700 // 20
    if kind == "clusters":
        assert work < 0.4 * all_


def test_bounds_hold_for_every_block():
    rng = np.random.default_rng(5)
    for angular in (True, False):
        x = rng.normal(size=(800, 6)) + 3 * np.eye(6)[rng.integers(0, 6, 800)]
        c = cells.fitted(x[:300], angular, lambda c: -len(c.cell))
        ring, near = c.block_of(c.distances(x))
        c = c.with_blocks(cells.summed(ring, near, cells.lengths(x)))
        own = c.numbers(ring, np.unique(ring))
        q = rng.normal(size=(50, 6)) * 2
        gap = c.gaps(c.distances(q))
        cos = np.clip(q @ x.T / cells.lengths(q)[:, None] / cells.lengths(x), -1, 1)
        true = np.arccos(cos) if angular else np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
        assert (gap[:, own] <= true + 1e-9).all() and c.count.sum() == 800 and len(c.cell) > 6


def test_blocks_are_compared_in_bounded_memory_and_equal_vectors_tie():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(31)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[5000:] = x[:1000]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = (pd.DataFrame({"item_id": np.arange(n), "v": list(x[:n])}) for n in (1024, 6000))
    tracemalloc.start()
    found, near = pairs._compared(a, b, 0.3, True), pairs._nearest(a, b, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    d = 1 - x[:1024].astype(float) @ x.astype(float).T
    i, j = np.nonzero((d < 0.3) & (np.arange(1024)[:, None] < np.arange(6000)))
    assert set(zip(found.i, found.j)) == set(zip(i.tolist(), j.tolist()))
    d[np.arange(1024), np.arange(1024)] = np.inf
    for q, own in near.groupby("query_id"):
        assert list(own.sort_values(["dist", "item_id"]).item_id) == list(np.lexsort((np.arange(6000), np.round(d[q], 9)))[:5])


def test_of_equal_codes_only_the_smallest_ids_are_searched(spark):
    x = table("no clusters", n=600, dim=8)
    df = frame(spark, x)
    book = quantizer.as_table(df, np.array([[[0.1] * 4], [[0.2] * 4]]))
    got, work = quantizer.adc_search(df, quantizer.encode(df, book), book, 6)
    assert work == 600 * 6
    assert {(r.query_id, r.rank, r.item_id) for r in got.collect()} == {(q, k + 1, k) for q in range(600) for k in range(6)}


def test_blocks_in_which_all_is_near_are_handed_on_in_runs(spark):
    import tracemalloc

    import pandas as pd

    x = np.ones((2000, 4), np.float32) / 2
    p = pd.DataFrame({"item_id": np.arange(2000), "v": list(x)})
    tracemalloc.start()
    sizes = [len(run) for run in pairs._runs(p, p, 0.3, True)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 2000 * 1999 // 2 and max(sizes) < 2 * pairs.RUN and len(sizes) > 4
    assert most < 48 << 20
    got = pairs.pairs_within(frame(spark, x[:700]), 0.3, block=500)
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == [(i, j) for i in range(700) for j in range(i + 1, 700)]


def test_fitting_cells_takes_little_of_the_driver():
    import tracemalloc

    from kindred.operators import cells, pairs

    x = np.random.default_rng(3).normal(size=(4096, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    cells.fitted(x, True, pairs._join_cost(x, 50_000, 0.6, 8192))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
