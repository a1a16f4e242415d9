import threading

import numpy as np
import pytest

from kindred.operators import pixels
from kindred.plans import extraction
from kindred.sources import cache

ITEMS = "path string, mtime double, content array<float>"


class Sums:
    """Two sums of a row's numbers; a row of a 9 breaks the model, and one of a -1 can't be read."""

    name, dim = "sums", 2

    def __init__(self, log=None):
        self.log = log

    def load(self):
        return np.array([[1.0, 2.0], [3.0, 4.0]])

    def prepare(self, content):
        if -1 in content:
            raise OSError("unreadable")
        return None if 0 in content and len(content) == 1 else np.array(content, np.float64)

    def embed(self, model, batch):
        if self.log is not None:
            self.log.append(len(batch))
        if (batch == 9).any():
            raise RuntimeError("broken")
        return batch[:, :2] @ model


def items(n):
    rows = [(f"p{i}", float(i), [float(i % 7 + 1), 2.0]) for i in range(n)]
    return rows + [("bad", 1.0, [-1.0]), ("none", 1.0, None), ("empty", 1.0, [0.0]), ("poison", 1.0, [9.0, 1.0]), ("long", 1.0, [3.0, 1.0, 5.0]), ("same", 2.0, [1.0, 1.0]), ("same", 2.0, [1.0, 1.0]), ("inf", 1.0, [float("inf"), 1.0])]


def wanted(content):
    y = np.array(content[:2]) @ Sums().load()
    return (y / np.linalg.norm(y)).astype(np.float32)


@pytest.mark.parametrize("prefetch", [0, 1, 3])
def test_every_row_has_a_vector_or_a_reason(spark, prefetch):
    rows = items(100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = extraction.extract(spark.createDataFrame(rows, ITEMS).coalesce(1), Sums(), batch=16, prefetch=prefetch).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.path for r in got] == [r[0] for r in rows]
    failures = {r.path: r.failure for r in got if r.failure}
    assert failures == {"bad": "OSError: unreadable", "none": "no content", "empty": "no content", "poison": "RuntimeError: broken", "inf": "not finite"}
    for r, (_, _, content) in zip(got, rows, strict=True):
        assert (r.embedding is None) == (r.path in failures) and (r.embedding is None or (np.array(r.embedding, np.float32) == wanted(content)).all())
    assert extraction.extract(spark.createDataFrame([], ITEMS), Sums()).count() == 0


def test_model_batches_are_full_across_arrow_batches():
    log = []
    e = Sums(log)
    rows = iter([(f"p{i}", 0.0, [1.0, float(i)]) for i in range(50)] + [("bad", 0.0, [-1.0])] * 500)
    runs = list(extraction.prepared(e, rows, 16))
    assert [sum(r[2] is not None for r in run) for run in runs if any(r[2] is not None for r in run)] == [16, 16, 16, 2]
    assert sum(map(len, runs)) == 550
    assert extraction.embed_one(e, [1.0, 2.0]).tolist() == wanted([1.0, 2.0]).tolist() and extraction.embed_one(e, [0.0]) is None


def test_reading_ahead_ends_its_thread_and_hands_errors_on():
    before = threading.active_count()

    def source():
        yield from range(100)
        raise KeyError("end")

    taken = extraction.ahead(source(), 2)
    assert [next(taken) for _ in range(5)] == list(range(5))
    taken.close()
    with pytest.raises(KeyError):
        list(extraction.ahead(source(), 3))
    assert threading.active_count() == before


class Wrong(Sums):
    name, dim = "wrong", 3


class Missing(Sums):
    name = "missing"

    def load(self):
        raise FileNotFoundError("no model")


def test_models_that_do_not_fit_or_load_raise(spark):
    df = spark.createDataFrame(items(3)[:3], ITEMS)
    for e in (Wrong(), Missing()):
        with pytest.raises(Exception, match="components|no model"):
            extraction.extract(df, e).collect()


class Never(Sums):
    name = "never"

    def embed(self, model, batch):
        raise AssertionError("computed again")


class Later(Sums):
    """Fails for good on every path but those of the first pieces."""

    name = "later"

    def load(self):
        raise OSError("worker lost")


def test_a_run_broken_off_repeats_only_what_is_missing(spark, tmp_path, monkeypatch):
    store = cache.embeddings(spark, str(tmp_path / "e"), buckets=8)
    df = spark.createDataFrame(items(60), ITEMS)
    real, calls = extraction.extract, []

    def breaks(todo, e, **kw):
        calls.append(todo.count())
        if len(calls) == 3:
            raise OSError("driver lost")
        return real(todo, e, **kw)

    monkeypatch.setattr(extraction, "extract", breaks)
    with pytest.raises(OSError):
        extraction.extract_cached(df, Sums(), store, piece=12)
    done = store.count()
    assert 0 < done < 60 and len(calls) == 3
    again = extraction.extract_cached(df, Sums(), store, piece=12)
    t = extraction.totals(again).first()
    assert (t["items"], t["failed"]) == (68, 5) and t["cached"] >= done and t["cached"] + t["computed"] == 63
    third = extraction.extract_cached(df.where("path not in ('bad', 'none', 'empty', 'poison', 'inf')"), Never(), store)
    assert extraction.totals(third).first()["cached"] == 63 and third.where("embedding is null").count() == 0
    changed = df.withColumn("mtime", df.mtime + 5).where("path = 'p3'")
    assert extraction.totals(extraction.extract_cached(changed, Sums(), store)).first()["computed"] == 1 and store.count() == 62
    zero = extraction.with_zero_vectors(again, 2).where("path = 'bad'").first()
    assert list(zero.embedding) == [0.0, 0.0]


def plain_scale(x, target, reverse):
    h, w, c = x.shape
    out = np.zeros((c, *target))
    for k in range(c):
        for i in range(target[0]):
            for j in range(target[1]):
                y, z = (min(max((a + 0.5) * n / t - 0.5, 0), n - 1) for a, n, t in ((i, h, target[0]), (j, w, target[1])))
                y0, z0 = int(y), int(z)
                y1, z1 = min(y0 + 1, h - 1), min(z0 + 1, w - 1)
                p = x[:, :, c - 1 - k if reverse else k].astype(float)
                v = (p[y0, z0] * (1 - (y - y0)) + p[y1, z0] * (y - y0)) * (1 - (z - z0)) + (p[y0, z1] * (1 - (y - y0)) + p[y1, z1] * (y - y0)) * (z - z0)
                out[k, i, j] = np.floor(v + 0.5) / 255
    return out.astype(np.float32)


@pytest.mark.parametrize("shape", [(1, 1, 3), (5, 3, 3), (7, 9, 1), (2, 30, 4)])
def test_scaled_pixels_equal_a_plain_version(shape):
    x = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    for target, reverse in (((4, 6), True), ((11, 2), False), (shape[:2], True)):
        assert np.abs(pixels.scaled(x, target, reverse) - plain_scale(x, target, reverse)).max() < 1.01 / 255
        assert (pixels.scaled(x, target, reverse) == plain_scale(x, target, reverse)).mean() > 0.99
    assert pixels.scaled(x).shape == (shape[2], 224, 224)
    assert (pixels.scaled(x, shape[:2]) * 255).round().astype(np.uint8).transpose(1, 2, 0)[:, :, ::-1].tolist() == x.tolist()


def test_rows_whose_data_do_not_fit_have_no_pixels(spark):
    rows = [(1, 2, 2, 3, bytes(range(12))), (2, 2, 2, 3, b"x"), (3, None, 2, 3, b""), (4, 0, 0, 3, b""), (5, 1, 1, 1, None), (None, 1, 1, 1, b"\xff")]
    df = spark.createDataFrame(rows, "item_id long, height int, width int, channels int, data binary")
    got = {r.item_id: r.pixels for r in pixels.scale_pixels(df, (2, 2)).collect()}
    assert [k for k, v in got.items() if v is None] == [2, 3, 4, 5] and list(got[None]) == [1.0] * 4
    assert np.allclose(np.array(got[1]) * 255, [2, 5, 8, 11, 1, 4, 7, 10, 0, 3, 6, 9])
