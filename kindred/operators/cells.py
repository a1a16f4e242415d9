"""A metric index of vectors: cells around reference points, parted into rings, with bounds by the triangle inequality.

Reference points are spread over a bounded sample, so the index may be sent to every task. A ring is known by how near and how
far its vectors are from its point, which bounds their distance to any other vector. How many points pay is estimated on the
sample; one cell without rings, which prunes nothing, is always among the choices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of the sample, and numbers of reference points that are tried.
SAMPLE, POINTS = 4096, (16, 64, 256, 1024)
#: Rings end at these shares of the sample, by distance from the nearest point.
RINGS = (0.25, 0.5, 0.75, 0.9, 0.99)
#: Rounding that bounds allow for, as a share of the longest vector.
SLACK = 1e-6
#: Costs in comparisons of two vectors: a row that is sent to a block, and a block.
ROW_COST, BLOCK_COST = 2e3, 2e5
ROWS = 1024
#: Rows that a task hands on at once.
RUN = 1 << 14


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


@dataclass(frozen=True)
class Cells:
    """Reference points; a block is a ring of a cell: its cell, nearest and farthest distance, number and shortest and longest of its vectors."""

    points: np.ndarray
    edges: np.ndarray
    angular: bool
    cell: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    count: np.ndarray | None = None
    shortest: np.ndarray | None = None
    longest: np.ndarray | None = None

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Angle, or Euclidean distance, of each row to each point."""
        if self.angular:
            return np.arccos(np.clip(x @ self.points.T / lengths(x)[:, None], -1, 1))
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.points**2).sum(1) - 2 * x @ self.points.T, 0))

    def block_of(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the ring, over all cells, and distance to its point, of rows with `distances` d."""
        cell = d.argmin(axis=1)
        near = d[np.arange(len(d)), cell]
        return cell * (len(self.edges) + 1) + np.searchsorted(self.edges, near, side="right"), near

    def gaps(self, d: np.ndarray) -> np.ndarray:
        """How near, at least, rows with `distances` d are to any vector of each block; 0 where it may hold them."""
        at = d[:, self.cell]
        slack = SLACK * max(1.0, float(self.longest.max(initial=1.0)))
        return np.maximum(np.maximum(at - self.high, self.low - at) - slack, 0)

    def with_blocks(self, rows: list) -> Cells:
        """The same with what is known of its blocks: (ring, count, low, high, shortest, longest) each."""
        at = np.array([tuple(r) for r in sorted(rows)], np.float64).reshape(-1, 6)
        return replace(self, cell=at[:, 0].astype(np.int64) // (len(self.edges) + 1), count=at[:, 1].astype(np.int64), low=at[:, 2], high=at[:, 3], shortest=at[:, 4], longest=at[:, 5])

    def numbers(self, rings: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places of rings among the blocks, whose rings are `known` in order."""
        return np.searchsorted(known, rings)


def summed(ring: np.ndarray, near: np.ndarray, length: np.ndarray) -> list[tuple]:
    """(ring, count, low, high, shortest, longest) of each ring."""
    names, at, n = np.unique(ring, return_inverse=True, return_counts=True)
    ends = [np.full(len(names), s * np.inf) for s in (1, -1, 1, -1)]
    for out, op, x in zip(ends, (np.minimum, np.maximum) * 2, (near, near, length, length), strict=True):
        op.at(out, at, x)
    return list(zip(names.tolist(), n.tolist(), *(e.tolist() for e in ends), strict=True))


def spread(sample: np.ndarray, most: int, angular: bool) -> np.ndarray:
    """Up to `most` rows, each the farthest from those before it."""
    x = sample / lengths(sample)[:, None] if angular else sample
    square, out = (x * x).sum(1), [0]
    near = np.full(len(x), np.inf)
    while len(out) < min(most, len(x)):
        near = np.minimum(near, square + square[out[-1]] - 2 * x @ x[out[-1]])
        far = int(near.argmax())
        if near[far] <= 1e-12 * max(1.0, square.max()):
            break
        out.append(far)
    return x[out]


def sampled(rows: DataFrame, column: str, n: int = SAMPLE, seed: int = 11) -> np.ndarray:
    found = rows.select(column, F.xxhash64("item_id", F.lit(seed)).alias("h")).orderBy("h").limit(n).collect()
    return np.array([r[0] for r in found], np.float64)


def fitted(sample: np.ndarray, angular: bool, cost: Callable[[Cells], float]) -> Cells:
    """The cells of least `cost`, which is told their blocks in the sample. Distances are made of ROWS vectors at once, as the driver makes them."""
    runs = [sample[k : k + ROWS] for k in range(0, len(sample), ROWS)]
    order = spread(sample, POINTS[-1], angular)
    choices = [Cells(order[:1], np.zeros(0), angular)]
    for p in POINTS:
        if p <= len(order):
            c = Cells(order[:p], np.zeros(0), angular)
            choices.append(replace(c, edges=np.unique(np.quantile(np.concatenate([c.distances(x).min(axis=1) for x in runs]), RINGS))))
    length, best = lengths(sample), None
    for c in choices:
        ring, near = (np.concatenate(y) for y in zip(*(c.block_of(c.distances(x)) for x in runs), strict=True))
        c = c.with_blocks(summed(ring, near, length))
        found = cost(c)
        if best is None or found < best[0]:
            best = found, c
    return best[1]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def measured(rows: DataFrame, cells: Cells, read: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[Cells, np.ndarray]:
    """`cells` with the blocks of all `rows`, whose batches `read` turns into vectors, and the blocks' rings. One row a block reaches the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for b in pieces(batches):
            x = read(b)
            found += summed(*sent.value.block_of(sent.value.distances(x)), lengths(x))
            if len(found) > RUN:
                yield batch_of(found)
                found = []
        yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["ring", "n", "low", "high", "short", "long"])

    parts = rows.mapInArrow(run, "ring long, n long, low double, high double, short double, long double")
    out = parts.groupBy("ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("short").alias("short"), F.max("long").alias("long")).collect()
    return cells.with_blocks(out), np.array(sorted(r.ring for r in out), np.int64)


def tallied(rows: DataFrame, visits: Callable[[pa.RecordBatch], np.ndarray], blocks: int) -> np.ndarray:
    """How many rows visit each block; `visits` tells the blocks that a batch's rows visit, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(blocks, np.int64)
        for b in pieces(batches):
            n += np.bincount(visits(b), minlength=blocks)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], names=["b", "n"])

    out = np.zeros(blocks, np.int64)
    for r in rows.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # one row a block
        out[r.b] = r.n
    return out


def spread_out(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For numbers of copies n: the place of each copy's original, and its number among them."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def dealt(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A part for each id, from 0 up to its number of parts."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)


def copies(rows: pa.RecordBatch, at: np.ndarray, /, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows `at` of a batch with further int columns, in runs."""
    for k in range(0, len(at), RUN):
        some = rows.take(pa.array(at[k : k + RUN]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c[k : k + RUN], pa.int32()) for c in columns.values()), *some.columns], names=[*columns, *rows.schema.names])
