"""Centroid clustering of integer vectors by Elkan's bounds.

Every vector carries an upper bound of the distance to its own centroid and a lower bound of that to each of the k centroids.
A round moves the bounds by what the centroids moved, then calculates only distances that the bounds and the distances between
centroids leave open. Bounds are rounded away from what they prove and skip strictly larger distances alone, so ties are always
calculated; distances themselves are exact integers, as are the sums from which centroids follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import cut

#: Integer components reach so far at most: 64 squared differences then fit a long.
LIMIT = 1 << 27
#: Largest numbers of which float64 products of whole rows are exact.
EXACT = 1 << 53
ROWS = 2048
STATE = "id long, x array<int>, own int, was int, upper float, lower array<float>, tested int"


def integers(v: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * v.astype(np.float64)).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids) of integer rows."""
    most = 2 * int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if x.shape[1] * most * most < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def above(d2: np.ndarray) -> np.ndarray:
    """float32 not below the roots of integers."""
    return np.nextafter(np.sqrt(d2.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def below(d2: np.ndarray) -> np.ndarray:
    """float32 not above the roots of integers."""
    return np.maximum(np.nextafter(np.sqrt(d2.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def first_round(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nearest centroid (ties to the smaller number), bounds and calculated distances of each row, from all distances."""
    d2 = squared(x, c)
    own = d2.argmin(axis=1).astype(np.int32)
    return own, above(d2[np.arange(len(x)), own]), below(d2), np.full(len(x), len(c), np.int32)


def next_round(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same from what the round before left. `moved`: what each centroid moved at most; `half`: half the distance of two centroids at least."""
    up, down = np.float32(np.inf), np.float32(-np.inf)
    upper = np.nextafter(upper + moved[own], up)
    lower = np.maximum(np.nextafter(lower - moved, down), np.float32(0))
    own, tested, k = own.copy(), np.zeros(len(x), np.int32), np.arange(len(c))

    def open_(r: np.ndarray) -> np.ndarray:
        return (lower[r] <= upper[r, None]) & (half[own[r]] <= upper[r, None]) & (k != own[r][:, None])

    rows = np.flatnonzero(open_(np.arange(len(x))).any(axis=1))
    best = ((x[rows] - c[own[rows]]) ** 2).sum(1)
    upper[rows], lower[rows, own[rows]] = above(best), below(best)
    tested[rows] += 1
    at, to = np.nonzero(open_(rows))
    if len(at):
        d2 = ((x[rows[at]] - c[to]) ** 2).sum(1)
        lower[rows[at], to] = below(d2)
        np.add.at(tested, rows[at], 1)
        # of a row's centroids the nearest, then the smallest number
        r, to, d2 = np.concatenate([np.arange(len(rows)), at]), np.concatenate([own[rows], to]), np.concatenate([best, d2])
        order = np.lexsort((to, d2, r))
        first = order[np.unique(r[order], return_index=True)[1]]
        own[rows], upper[rows] = to[first], above(d2[first])
    return own, upper, lower, tested


def floats(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), kind))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def state_batch(ids: pa.Array, x: np.ndarray, was: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, tested: np.ndarray) -> pa.RecordBatch:
    columns = [ids, lists(x, pa.int32()), pa.array(own), pa.array(was, pa.int32()), pa.array(upper), lists(lower, pa.float32()), pa.array(tested)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in STATE.split(", ")])


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: float) -> DataFrame:
    """(id, v) of vectors with exactly `dim` components, all finite and within LIMIT once scaled."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float(LIMIT))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.where(F.coalesce((F.size("v") == dim) & sound, F.lit(False)))


class Sums:
    """Counts and component sums of the clusters, exact, brought up to date by the vectors that changed their cluster."""

    def __init__(self, k: int, dim: int):
        self.n, self.total = [0] * k, [[0] * dim for _ in range(k)]

    def add(self, state: DataFrame) -> None:
        k, dim = len(self.n), len(self.total[0])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
            for b in pieces(batches):
                x = floats(b.column("x"), dim).astype(np.int64)
                for name, sign in (("own", 1), ("was", -1)):
                    at = b.column(name).to_numpy()
                    for c in np.unique(at[at >= 0]):
                        n[c] += sign * int((at == c).sum())
                        total[c] += sign * x[at == c].sum(axis=0)
            hit = np.flatnonzero((n != 0) | total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(n[hit]), lists(total[hit], pa.int64())], names=["c", "n", "s"])

        moved = state.where("own <> was").select("x", "own", "was").mapInArrow(partial, "c int, n long, s array<long>")
        # k rows
        for r in moved.groupBy("c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[w]) for w in range(dim))).alias("s")).collect():
            self.n[r.c] += r.n
            self.total[r.c] = [a + b for a, b in zip(self.total[r.c], r.s, strict=True)]

    def centroids(self, before: np.ndarray) -> np.ndarray:
        return np.array([[s // n for s in t] if n else b.tolist() for n, t, b in zip(self.n, self.total, before, strict=True)], np.int64)


def rounds_of(vectors: DataFrame, *, k: int, rounds: int, dim: int, scale: float, id_col: str, vector_col: str, seed: int) -> tuple[list[DataFrame], np.ndarray]:
    """The state table after each of `rounds` rounds and the centroids that follow from the last; no table without kept vectors."""
    rows = kept_vectors(vectors, id_col, vector_col, dim, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    c = integers(np.array([r.v for r in start], np.float64).reshape(len(start), dim), scale)
    if not len(c):
        return [], c
    sums, states, sc = Sums(len(c), dim), [], vectors.sparkSession.sparkContext

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = integers(floats(b.column("v"), dim), scale)
            yield state_batch(b.column("id"), x, np.full(len(x), -1, np.int32), *first_round(x, sent.value))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, moved, half = sent.value
        for b in pieces(batches):
            x, own = floats(b.column("x"), dim).astype(np.int64), b.column("own").to_numpy()
            yield state_batch(b.column("id"), x, own, *next_round(x, own, b.column("upper").to_numpy(), floats(b.column("lower"), len(book)), book, moved, half))

    sent = sc.broadcast(c)  # k vectors
    for r in range(rounds):
        states.append(cut(states[-1].mapInArrow(go_on, STATE) if r else rows.mapInArrow(begin, STATE)))
        sums.add(states[-1])
        was, c = c, sums.centroids(c)
        sent = sc.broadcast((c, above(((c - was) ** 2).sum(1)), below(squared(c, c)) / np.float32(2)))
    states.append(states[-1].mapInArrow(go_on, STATE))
    return states, c


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, tested) of every kept vector, x being floor(scale * component).

    Kept: `dim` components, none null or not finite, and none that scales beyond LIMIT, as its distances would not fit a long.
    Centroids start as the `k` kept vectors of smallest sha256 of "seed:id" (all, if fewer; without id last, equal ids by
    their vectors). Each round assigns every vector to its nearest centroid, ties to the smaller number, and turns non-empty
    centroids into the floor of their vectors' mean; vectors are assigned once more at the end. `distance` is squared and
    exact, inertias are its sums over the cluster and over all, `tested` is how many distances the last round calculated.
    Repeated rows and ids count each; rows without id are answered. Without kept vectors there are no rows.
    """
    states, c = rounds_of(vectors, k=k, rounds=rounds, dim=dim, scale=scale, id_col=id_col, vector_col=vector_col, seed=seed)
    schema = "id long, cluster int, distance long, tested int"
    spark = vectors.sparkSession
    if not states:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, tested int")
    sent = spark.sparkContext.broadcast(c)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            own = b.column("own").to_numpy()
            d2 = ((floats(b.column("x"), dim).astype(np.int64) - sent.value[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("own"), pa.array(d2), b.column("tested")], names=["id", "cluster", "distance", "tested"])

    out = cut(states[-1].mapInArrow(end, schema))
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    info = spark.createDataFrame([(i, sums[i], sum(sums.values()), c[i].tolist()) for i in sums], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(info), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "tested")

