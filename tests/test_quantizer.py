import numpy as np
import pytest

from kindred.operators import quantizer

RNG = np.random.default_rng(21)


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<float>")


@pytest.fixture(scope="module")
def vectors():
    x = RNG.normal(size=(90, 8)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lloyd(x, c, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def test_training_equals_k_means_of_each_part(spark, vectors):
    items = table(spark, vectors)
    start = quantizer.first_rows_codebook(items, 4, 5, 8)
    got = quantizer.as_array(quantizer.train(items, 4, 5, 8, iterations=7, tolerance=0.0, start=start))
    x = vectors.astype(np.float64)
    for m in range(4):
        part = x[:, 2 * m : 2 * m + 2]
        assert np.allclose(got[m], lloyd(part, part[:5], 7))


def test_training_is_the_same_each_time_and_keeps_empty_centroids(spark):
    x = np.repeat([[0.0, 0.0], [1.0, 1.0]], 20, axis=0)
    items = table(spark, x)
    a, b = (quantizer.as_array(quantizer.train(items, 1, 3, 2)) for _ in range(2))
    assert (a == b).all() and np.isfinite(a).all()


def test_codes_decode_to_nearest_centroids(spark, vectors):
    items = table(spark, vectors)
    book = quantizer.first_rows_codebook(items, 4, 5, 8)
    c = quantizer.as_array(book)
    codes = quantizer.encode(items, book)
    for r in quantizer.decode(codes, book).collect():
        want = [c[m][((vectors[r.item_id, 2 * m : 2 * m + 2] - c[m]) ** 2).sum(1).argmin()] for m in range(4)]
        assert np.allclose(r.embedding, np.concatenate(want))
    with pytest.raises(Exception, match="outside the codebook"):
        quantizer.decode(spark.createDataFrame([(1, [0, 0, 9, 0])], "item_id long, codes array<int>"), book).collect()
    assert quantizer.encode(items.limit(0), book).count() == 0


def test_search_by_codes_equals_brute_force_in_blocks(spark, vectors):
    items = table(spark, vectors)
    book = quantizer.first_rows_codebook(items, 4, 5, 8)
    codes = quantizer.encode(items, book)
    whole = {r.item_id: np.array(r.embedding) for r in quantizer.decode(codes, book).collect()}
    got = {}
    for r in quantizer.adc_top_k(items, codes, book, 6, block=17).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.item_id, r.dist)
    for q, rows in got.items():
        d = sorted((round(float(((vectors[q].astype(np.float64) - v) ** 2).sum()), 9), i) for i, v in whole.items())
        assert [(round(rows[k][1], 9), rows[k][0]) for k in range(1, 7)] == d[:6]
    assert len(got) == 90


def test_quantized_search_finds_planted_copies(spark):
    x = RNG.normal(size=(60, 8))
    x[30:] = x[:30] + RNG.normal(size=(30, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = {r.item_id: r.label for r in quantizer.quantized_clusters(table(spark, x), 0.05, parts=4, size=16, dim=8, strict=True).collect()}
    assert sum(labels[i] == labels[i + 30] for i in range(30)) >= 27


def test_shapes_are_checked(spark, vectors):
    items = table(spark, vectors)
    with pytest.raises(ValueError, match="multiple"):
        quantizer.train(items, 3, 4, 8)
    with pytest.raises(ValueError, match="fewer items"):
        quantizer.train(items.limit(3), 4, 5, 8)


def plain_training(x, book, iterations, tolerance=1e-4):
    parts, size, width = book.shape
    book, active = book.copy(), np.ones(parts, bool)
    for _ in range(iterations):
        code, new = quantizer.codes_of(x, book), book.copy()
        for m in np.flatnonzero(active):
            for k in range(size):
                if (code[:, m] == k).any():
                    new[m, k] = x[code[:, m] == k, m * width : (m + 1) * width].mean(axis=0)
        active &= np.sqrt(((new - book) ** 2).sum(2)).max(axis=1) > tolerance
        book = new
        if not active.any():
            break
    return book


@pytest.mark.parametrize("iterations", [1, 2, 14])
def test_training_by_bounds_equals_training_by_all_distances(spark, iterations):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20, 12))[rng.integers(0, 20, 1500)] + 0.15 * rng.normal(size=(1500, 12))
    x[100:130] = x[99]  # copies
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    start, report = quantizer.first_rows_codebook(items, 3, 8, 12), []
    got = quantizer.as_array(quantizer.train(items, 3, 8, 12, iterations=iterations, tolerance=-1.0, start=start, report=report))
    assert np.abs(got - plain_training(x, quantizer.as_array(start), iterations, -1.0)).max() < 1e-9
    if iterations == 14:
        assert report[0] == 1.0 and len(report) == 14 and max(report[9:]) < 0.3
