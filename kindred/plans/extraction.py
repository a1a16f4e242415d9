"""Vectors of items by a pluggable embedder: from the cache where they are valid, else computed in model batches and cached.

An embedder is an object with `name`, `dim`, `load()`, `prepare(content)` and `embed(model, batch)`. It is sent to tasks; what
`load` returns (a session, weights) is kept once a worker process. `prepare` turns a row's content into an array, or raises or
returns None for content that can't be read. `embed` turns stacked arrays into as many vectors of `dim` components.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.lineage import cut
from kindred.sources.cache import CacheTable, hits, misses

#: Rows of a model batch, batches prepared ahead of the model, and rows of one write to the cache.
BATCH, AHEAD, PIECE = 32, 2, 1_000_000
EXTRACTED = "path string, mtime double, embedding array<float>, failure string"

_models: dict[str, Any] = {}


class Embedder(Protocol):
    name: str
    dim: int

    def load(self) -> Any: ...

    def prepare(self, content: Any) -> np.ndarray | None: ...

    def embed(self, model: Any, batch: np.ndarray) -> np.ndarray: ...


def model_of(e: Embedder) -> Any:
    """What `load` returned in this process."""
    if e.name not in _models:
        _models[e.name] = e.load()
    return _models[e.name]


def prepared(e: Embedder, rows: Iterator[tuple[str, float, Any]], batch: int) -> Iterator[list[tuple[str, float, np.ndarray | None, str | None]]]:
    """Rows (path, mtime, array, failure) in order, in runs that hold `batch` arrays of one shape, or fewer at the end or where shapes change."""
    run: list[tuple[str, float, np.ndarray | None, str | None]] = []
    ready, shape = 0, None
    for path, mtime, content in rows:
        try:
            x = None if content is None else e.prepare(content)
            failure = "no content" if x is None else None
        except Exception as error:  # one row's content never ends the whole extraction
            x, failure = None, f"{type(error).__name__}: {error}"[:200]
        if x is not None and ready and (ready == batch or x.shape != shape):
            yield run
            run, ready = [], 0
        if x is not None:
            ready, shape = ready + 1, x.shape
        run.append((path, mtime, x, failure))
        if len(run) >= 64 * batch:  # a long row of failures
            yield run
            run, ready = [], 0
    if run:
        yield run


def ahead(source: Iterator, n: int) -> Iterator:
    """`source` read by a thread of its own, up to `n` elements ahead; as it is if `n` is 0."""
    if n < 1:
        yield from source
        return
    line: queue.Queue = queue.Queue(n)
    stop = threading.Event()

    def put(x: tuple) -> bool:
        while not stop.is_set():
            try:
                line.put(x, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def read() -> None:
        try:
            for x in source:
                if not put((x, None)):
                    return
            put((None, StopIteration()))
        except BaseException as error:
            put((None, error))

    thread = threading.Thread(target=read, daemon=True)
    thread.start()
    try:
        while True:
            x, error = line.get()
            if isinstance(error, StopIteration):
                return
            if error is not None:
                raise error
            yield x
    finally:
        stop.set()
        thread.join()


def unit_vectors(e: Embedder, x: np.ndarray) -> list[np.ndarray | str]:
    """A unit vector of float32 for each row of a batch, or why it has none. If the model fails on the batch, its rows go one by one."""
    try:
        y = np.asarray(e.embed(model_of(e), x), np.float64)
    except Exception as error:
        if len(x) == 1:
            return [f"{type(error).__name__}: {error}"[:200]]
        return [v for k in range(len(x)) for v in unit_vectors(e, x[k : k + 1])]
    if y.shape != (len(x), e.dim):
        raise ValueError(f"the embedder returned {y.shape} for {len(x)} rows of {e.dim} components")
    n = np.linalg.norm(y, axis=1)
    return [(row / (k or 1.0)).astype(np.float32) if np.isfinite(k) else "not finite" for row, k in zip(y, n, strict=True)]


def embed_one(e: Embedder, content: Any) -> np.ndarray | None:
    """The vector of one content, here; None if it has none."""
    x = e.prepare(content)
    found = unit_vectors(e, x[None])[0] if x is not None else None
    return None if found is None or isinstance(found, str) else found


def extract(items: DataFrame, e: Embedder, *, batch: int = BATCH, prefetch: int = AHEAD) -> DataFrame:
    """(path, mtime, embedding, failure) of every row of `items` (path, mtime, content).

    Rows are handed to the model in batches of `batch` that Arrow's batches do not cut short; a thread prepares `prefetch` batches
    ahead (0: none). A row without vector has the reason in `failure` and ends nothing. No shuffle: a lost executor
    repeats its own tasks. A zero vector stays zero. A model that can't be loaded raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_of(e)
        rows = ((p.as_py(), m.as_py(), c.as_py()) for b in batches for p, m, c in zip(*b.columns, strict=True))
        for some in ahead(prepared(e, rows, batch), prefetch):
            x = [r[2] for r in some if r[2] is not None]
            made = iter(unit_vectors(e, np.stack(x)) if x else [])
            found = [next(made) if r[2] is not None else r[3] for r in some]
            vectors = [None if isinstance(v, str) else v for v in found]
            reasons = [v if isinstance(v, str) else None for v in found]
            columns = [pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.float64()), pa.array(vectors, pa.list_(pa.float32())), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "mtime", "embedding", "failure"])

    return items.select(F.col("path").cast("string"), F.col("mtime").cast("double"), "content").mapInArrow(run, EXTRACTED)


def extract_cached(items: DataFrame, e: Embedder, store: CacheTable, *, batch: int = BATCH, prefetch: int = AHEAD, piece: int = PIECE) -> DataFrame:
    """(path, mtime, embedding, failure, cached) of every row of `items` (path, mtime, content): `cached` ones are valid in `store`.

    The others are computed and cached in pieces of about `piece` rows, each of whole buckets of the cache, so a
    write rewrites no bucket twice. A run that was broken off finds the pieces that were done as hits. Rows without vector
    are not cached. Rows without path are computed, never cached. Rows that repeat a path are answered each.
    """
    here = items.select("path", "mtime")
    old = store.read()
    known = cut(hits(here, old).select("path", "mtime", "embedding"))
    todo = misses(items.select("path", "mtime", "content"), old)
    size, n = store.size(), misses(here, old).count()
    parts = max(1, min(size, -(-n // piece)))
    out = known.select("*", F.lit(None).cast("string").alias("failure"), F.lit(True).alias("cached"))
    bucket = F.coalesce(store.bucket(size), F.lit(0)) % parts
    for k in range(parts if n else 0):
        # the piece is a table before anything is shuffled: what a task computed stays, whoever is lost
        made = cut(extract(todo.where(bucket == k), e, batch=batch, prefetch=prefetch))
        store.upsert(made.where("failure is null").select("path", "mtime", "embedding"))
        out = out.unionByName(made.withColumn("cached", F.lit(False)))
    return out


def totals(extracted: DataFrame) -> DataFrame:
    """One row: items, those from the cache, those computed, and those without vector."""
    failed, cached = F.col("failure").isNotNull(), F.col("cached")
    return extracted.agg(F.count(F.lit(1)).alias("items"), F.count_if(cached).alias("cached"), F.count_if(~cached & ~failed).alias("computed"), F.count_if(failed).alias("failed"))


def with_zero_vectors(extracted: DataFrame, dim: int) -> DataFrame:
    """(path, mtime, embedding) with a zero vector for every row without vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return extracted.select("path", "mtime", F.coalesce("embedding", zero).alias("embedding"))
