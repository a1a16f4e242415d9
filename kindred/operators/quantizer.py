"""Product quantization: training, encoding, decoding, lookup-table distances, search and clustering by codes.

A codebook is a table (m, k, centroid) of parts * size rows. Its size hangs on these two parameters alone, never on the data,
so it may be collected and sent to every task; `as_array` checks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.vectors import cosine_distance
from kindred.operators.cells import sampled
from kindred.operators.clusters import WEAK_CAP, constrained_clusters
from kindred.operators.lineage import cut
from kindred.operators.pairs import TILE, bound_of, firsts, give, rough, search, sound

#: Bytes that a codebook may have.
CODEBOOK_BYTES = 64 << 20
#: Defaults of the search over large sets: parts, centroids of a part, neighbours of an item.
PARTS, SIZE, NEIGHBOURS = 96, 256, 5
CODES = 8192
#: Share of the parts of rows that need distances, from which bounds are taken anew; and what bounds give way for rounding.
REBASE, SLACK = 0.2, 1e-6
ROWS = 2048


def part_width(dim: int, parts: int) -> int:
    if parts < 1 or dim < 1 or dim % parts:
        raise ValueError("the dimension must be a multiple of the number of parts")
    return dim // parts


def as_array(codebook: DataFrame) -> np.ndarray:
    """A codebook as an array (parts, size, width)."""
    p = codebook.select("m", "k", "centroid").toPandas().sort_values(["m", "k"])
    parts, size = int(p.m.max()) + 1, int(p.k.max()) + 1
    if len(p) != parts * size:
        raise ValueError("a codebook has one row for each part and number")
    out = np.stack(p.centroid.to_list()).astype(np.float64).reshape(parts, size, -1)
    if out.nbytes > CODEBOOK_BYTES:
        raise ValueError("the codebook is too large to send to every task")
    return out


def as_table(items: DataFrame, book: np.ndarray) -> DataFrame:
    data = [(m, k, c.tolist()) for m, rows in enumerate(book) for k, c in enumerate(rows)]
    return items.sparkSession.createDataFrame(data, "m int, k int, centroid array<double>")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of float64; another length than `dim` raises."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError(f"all vectors must have {dim} components")
    return flat.reshape(len(column), dim)


def codes_of(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest centroid of every part of the rows of `x`, ties to the smaller number."""
    parts, _, width = book.shape
    out = np.empty((len(x), parts), np.int32)
    for m in range(parts):
        s = x[:, m * width : (m + 1) * width]
        out[:, m] = ((book[m] ** 2).sum(1) - 2 * s @ book[m].T).argmin(axis=1)
    return out


def first_rows_codebook(items: DataFrame, parts: int, size: int, dim: int) -> DataFrame:
    """The parts of the `size` items of smallest id as centroids."""
    return _from_rows(items, items.orderBy("item_id").limit(size), parts, size, dim)


def random_codebook(items: DataFrame, parts: int, size: int, dim: int, seed: int = 42) -> DataFrame:
    """The parts of `size` items drawn by seeded hash as centroids, so reruns agree."""
    return _from_rows(items, items.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string")).cast("binary")), "item_id").limit(size), parts, size, dim)


def _from_rows(items: DataFrame, some: DataFrame, parts: int, size: int, dim: int) -> DataFrame:
    width = part_width(dim, parts)
    rows = some.select("embedding").collect()
    if len(rows) < size:
        raise ValueError("fewer items than centroids")
    x = np.array([r.embedding for r in rows], np.float64)
    return as_table(items, np.ascontiguousarray(x.reshape(size, parts, width).transpose(1, 0, 2)))


class Bounds:
    """What proves that rows kept their codes: a codebook, how far its centroids moved since the bounds were taken, and which parts move still."""

    def __init__(self, book: np.ndarray, moved: np.ndarray, active: np.ndarray):
        self.book, self.moved, self.active = book, moved, active
        self.lengths = (book**2).sum(2)
        self.half = np.stack([_half_gaps(c) for c in book])

    def codes(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the rows of `x` by this codebook, with new bounds, and which parts of which rows needed distances.

        `upper` bounds the distance to the code's centroid, `lower` that to any other. Both give way by SLACK, so rows near a
        tie are always tested, by the same products as `codes_of`.
        """
        width = self.book.shape[2]
        code, tested = code.copy(), np.zeros(code.shape, bool)
        upper, lower = upper + self.moved[np.arange(len(self.book)), code], lower - self.moved.max(axis=1)
        for m in np.flatnonzero(self.active):
            r = np.flatnonzero(upper[:, m] >= np.maximum(lower[:, m], self.half[m, code[:, m]]))
            if not len(r):
                continue
            s, c = x[r, m * width : (m + 1) * width], self.book[m]
            scores = self.lengths[m] - 2 * s @ c.T
            best = scores.argmin(axis=1)
            d = np.sqrt(np.maximum(scores + (s * s).sum(1)[:, None], 0))
            rows = np.arange(len(r))
            near = d[rows, best]
            d[rows, best] = np.inf
            give = SLACK * (near + np.sqrt(self.lengths[m].max()))
            code[r, m], upper[r, m], lower[r, m], tested[r, m] = best, near + give, d.min(axis=1) - give, True
        return code, upper, lower, tested


def _half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to its nearest other one, at least."""
    d = (c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T
    np.fill_diagonal(d, np.inf)
    return np.sqrt(np.maximum(d.min(axis=1), 0)) / 2 * (1 - SLACK) - SLACK * np.sqrt((c * c).sum(1).max())


def _sums(codes: list[tuple[np.ndarray, np.ndarray, int]], parts: int, size: int, width: int, n: np.ndarray, total: np.ndarray) -> None:
    """Adds rows (x, codes, sign) to the counts and sums of their centroids."""
    for x, code, sign in codes:
        for m in range(parts):
            np.add.at(total[m], code[:, m], sign * x[:, m * width : (m + 1) * width])
            n[m] += sign * np.bincount(code[:, m], minlength=size)


def train(
    items: DataFrame, parts: int = PARTS, size: int = SIZE, dim: int = 768, *, iterations: int = 50, tolerance: float = 1e-4, seed: int = 42, start: DataFrame | None = None, report: list[float] | None = None
) -> DataFrame:
    """A codebook by k-means in every part at once, from `start` or `size` drawn items.

    A table holds each row's codes and bounds. A round reads it, calculates distances only where centroids have moved so far
    since that the bounds fail, and sums up only what changed its code; sums are made inside tasks and added up by aggregation.
    When over REBASE of the parts of rows need distances, the table is written anew. A centroid without vectors stays. A part is
    done when no centroid moves further than `tolerance`. Fewer items than `size` raise. `report` takes the share of parts
    of rows that each round calculated distances for.
    """
    width = part_width(dim, parts)
    book = as_array(start if start is not None else random_codebook(items, parts, size, dim, seed))
    if book.shape != (parts, size, width):
        raise ValueError("the start codebook has another shape")
    v = items.select("embedding").where("embedding is not null")
    active, moved, sc = np.ones(parts, bool), np.zeros((parts, size)), items.sparkSession.sparkContext
    state, base, due, rows = None, None, True, 0
    lists = "embedding array<double>, code array<int>, upper array<double>, lower array<double>, tested int"

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = matrix(b.column(0), dim)
        if b.num_columns == 1:
            return x, np.zeros((len(x), parts), np.int64), np.full((len(x), parts), np.inf), np.full((len(x), parts), -np.inf)
        return x, matrix(b.column(1), parts).astype(np.int64), matrix(b.column(2), parts), matrix(b.column(3), parts)

    def rebased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x, *was = read(batch.slice(at, ROWS))
                code, upper, lower, tested = sent.value.codes(x, *was)
                arrays = [pa.array(list(x), pa.list_(pa.float64())), pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())), *(pa.array(list(y), pa.list_(pa.float64())) for y in (upper, lower)), pa.array(tested.sum(axis=1), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["embedding", "code", "upper", "lower", "tested"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, whole = sent.value
        n, total, count = np.zeros((parts, size), np.int64), np.zeros((parts, size, width)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x, code, *was = read(batch.slice(at, ROWS))
                if whole:  # the table's own codes
                    count += int(batch.column(4).slice(at, ROWS).to_numpy().sum())
                    _sums([(x, code, 1)], parts, size, width, n, total)
                    continue
                new, _, _, tested = bounds.codes(x, code, *was)
                count += int(tested.sum())
                r = np.flatnonzero((new != code).any(axis=1))
                _sums([(x[r], code[r], -1), (x[r], new[r], 1)], parts, size, width, n, total)
        m, k = np.nonzero((n != 0) | (total != 0).any(axis=2))
        # what was tested comes as a part of its own
        arrays = [pa.array([*m, parts], pa.int32()), pa.array([*k, 0], pa.int32()), pa.array([*n[m, k], count], pa.int64()), pa.array([*total[m, k], np.zeros(width)], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["m", "k", "n", "s"])

    def added(whole: bool) -> tuple[np.ndarray, np.ndarray, int]:
        sums = state.mapInArrow(partial, "m int, k int, n long, s array<double>").groupBy("m", "k")
        n, total, count = np.zeros((parts, size), np.int64), np.zeros((parts, size, width)), 0
        for r in sums.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[w]) for w in range(width))).alias("s")).collect():  # a row a centroid
            if r.m == parts:
                count = r.n
            else:
                n[r.m, r.k], total[r.m, r.k] = r.n, r.s
        return n, total, count

    for _ in range(iterations):
        if due:
            sent = sc.broadcast(Bounds(book, moved, active))
            state, moved = cut((v if state is None else state).mapInArrow(rebased, lists)), np.zeros((parts, size))
            sent = sc.broadcast((None, True))
            n, total, count = added(True)
            base, rows, due = (n, total), int(n[0].sum()), False
        else:
            sent = sc.broadcast((Bounds(book, moved, active), False))
            n, total, count = added(False)
            n, total = base[0] + n, base[1] + total
            due = count > REBASE * rows * parts
        if report is not None:
            report.append(count / max(1, rows * parts))
        new = np.where((n > 0)[:, :, None] & active[:, None, None], total / np.maximum(n, 1)[:, :, None], book)
        step = np.sqrt(((new - book) ** 2).sum(2))
        moved = moved + step * (1 + SLACK)
        book, active = new, active & (step.max(axis=1) > tolerance)
        if not active.any():
            break
    return as_table(items, book)


def encode(items: DataFrame, codebook: DataFrame) -> DataFrame:
    """(item_id, codes array<int>): the nearest centroid of every part."""
    book = as_array(codebook)
    shared, dim = items.sparkSession.sparkContext.broadcast(book), book.shape[0] * book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(codes_of(matrix(b.column(1), dim), shared.value)), pa.list_(pa.int32()))], names=["item_id", "codes"])

    src = items.select(F.col("item_id").cast("long").alias("item_id"), "embedding").where("embedding is not null")
    return src.mapInArrow(run, "item_id long, codes array<int>")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """(item_id, embedding array<double>): the centroids that `codes` name, end to end. A number outside the codebook raises."""
    book = as_array(codebook)
    shared = codes.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                k = matrix(b.column(1), len(c)).astype(np.int64)
                if k.size and (k.min() < 0 or k.max() >= c.shape[1]):
                    raise ValueError("a code is outside the codebook")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(c[np.arange(len(c)), k].reshape(len(k), -1)), pa.list_(pa.float64()))], names=["item_id", "embedding"])

    return codes.select("item_id", "codes").mapInArrow(run, "item_id long, embedding array<double>")


def tables_of(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, parts, size) of every part of the rows of `x` to its centroids."""
    parts, size, width = book.shape
    return ((x.reshape(len(x), parts, 1, width) - book[None]) ** 2).sum(3)


def lookup_tables(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """(item_id, table array<array<double>>): the squared distance of each part of a query to each of its centroids."""
    book = as_array(codebook)
    shared, dim = queries.sparkSession.sparkContext.broadcast(book), book.shape[0] * book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                t = tables_of(matrix(b.column(1), dim), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.tolist(), pa.list_(pa.list_(pa.float64())))], names=["item_id", "table"])

    src = queries.select(F.col("item_id").cast("long").alias("item_id"), "embedding").where("embedding is not null")
    return src.mapInArrow(run, "item_id long, table array<array<double>>")


def table_distance(table: Column | str, codes: Column | str) -> Column:
    """Squared distance of a query with lookup `table` to the vector that `codes` stand for."""
    return F.aggregate(F.zip_with(table, codes, lambda t, k: F.element_at(t, k + 1)), F.lit(0.0), lambda a, x: a + x)


def adc_search(queries: DataFrame, codes: DataFrame, codebook: DataFrame, k: int, block: int = CODES, within: float | None = None) -> tuple[DataFrame, int]:
    """`adc_top_k` and the number of table distances it takes."""
    book = as_array(codebook)
    shared, dim = queries.sparkSession.sparkContext.broadcast(book), book.shape[0] * book.shape[2]

    def decoded(codes: np.ndarray) -> np.ndarray:
        c = shared.value
        return c[np.arange(len(c)), codes.astype(np.int64)].reshape(len(codes), -1)

    def nearest(x: pd.DataFrame, y: pd.DataFrame, k: int) -> pd.DataFrame:
        """The k codes of smallest table distance, from those that products in single precision leave."""
        found, ids, code, vx, c = [], y.item_id.to_numpy(), np.stack(y.codes.to_list()), matrix(pa.array(x.v), dim), shared.value
        vy, width, at_x = decoded(code), c.shape[2], x.item_id.to_numpy()
        (rx, ry), square = rough(vx, vy), (vy * vy).sum(1)
        slack = 2 * (2 * give(vx, vy) + give(vy, vy)) + 1e-12
        square = square.astype(ry.dtype)
        for at in range(0, len(rx), TILE):
            d = rx[at : at + TILE] @ ry.T
            d *= -2
            d += square
            r, to = np.nonzero(d <= (bound_of(d, k) + slack)[:, None])
            dist = np.zeros(len(r))
            for m in range(len(c)):
                s = vx[at : at + TILE, m * width : (m + 1) * width]
                dist += ((s[:, None] - c[m][None]) ** 2).sum(2)[r, code[to, m]]
            some = firsts(r, dist, ids[to], k)
            found.append(pd.DataFrame({"query_id": at_x[at + r[some]], "item_id": ids[to[some]], "dist": dist[some]}))
        return pd.concat(found).astype({"query_id": "int64", "item_id": "int64", "dist": "float64"})

    q = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("embedding").alias("v")).where("embedding is not null")
    # of equal codes only the k smallest ids can be among the nearest; others are left out where they are half of all or more
    same = F.row_number().over(Window.partitionBy("codes").orderBy("item_id"))
    c = cut(codes.select(F.col("item_id").cast("long").alias("item_id"), "codes"))
    first = cut(c.withColumn("same", same).where(F.col("same") <= k).drop("same"))
    c = first if 2 * first.count() <= c.count() else c
    return search(q, c, k, nearest, "codes", lambda b: decoded(matrix(b.column("codes"), len(shared.value))), lambda: decoded(sampled(c, "codes")), False, block, within)


def adc_top_k(queries: DataFrame, codes: DataFrame, codebook: DataFrame, k: int, block: int = CODES, within: float | None = None) -> DataFrame:
    """(query_id, item_id, dist, rank): for each query (item_id, embedding) the `k` codes of smallest table distance, ties to smaller ids.

    An item is not left out of its own search. A table distance is the squared distance to the vector that codes stand for, so
    cells of such vectors bound it: a query visits the nearest cells, and then those that may hold a nearer code than its k-th.
    Memory of a task is that of a block of codes and the tables of a few queries. With `within`, codes further than that
    may be missing.
    """
    return adc_search(queries, codes, codebook, k, block, within)[0]


def neighbour_pairs(items: DataFrame, codebook: DataFrame, threshold: float, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(i, j), i < j: pairs of which one is among the other's nearest by table distance, under 2 * threshold there.

    For unit vectors the squared Euclidean distance is twice the cosine distance.
    """
    v = sound(items).withColumnRenamed("v", "embedding")
    near = adc_top_k(v, encode(v, codebook), codebook, neighbours + 1, within=2 * threshold)
    pairs = near.where((F.col("dist") < 2 * threshold) & (F.col("query_id") != F.col("item_id")))
    return pairs.select(F.least("query_id", "item_id").alias("i"), F.greatest("query_id", "item_id").alias("j")).distinct()


def exact_distances(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, dist): `pairs` (i, j) with the cosine distance of their unit vectors."""
    v = sound(items)
    both = pairs.join(v.toDF("i", "va"), "i").join(v.toDF("j", "vb"), "j")
    return both.select("i", "j", cosine_distance("va", "vb").alias("dist"))


def neighbour_edges(items: DataFrame, codebook: DataFrame, threshold: float, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(i, j, dist) of `neighbour_pairs`, with their exact distance, which may exceed the threshold."""
    return exact_distances(items, cut(neighbour_pairs(items, codebook, threshold, neighbours)))


def clusters_of(items: DataFrame, edges: DataFrame, threshold: float, ratio: float = 0.7, cap: int = WEAK_CAP, strict: bool = False) -> DataFrame:
    """(item_id, label): size-constrained merging over `edges` of `neighbour_edges`.

    As all weak edges merge up to `cap` members, so may edges whose exact distance exceeds the threshold; `strict` leaves them out.
    """
    return constrained_clusters(items, edges.where(F.col("dist") < threshold) if strict else edges, threshold, ratio, cap)


def quantized_clusters(items: DataFrame, threshold: float, ratio: float = 0.7, *, parts: int = PARTS, size: int = SIZE, dim: int = 768, neighbours: int = NEIGHBOURS, cap: int = WEAK_CAP, strict: bool = False, codebook: DataFrame | None = None) -> DataFrame:
    """(item_id, label): a codebook, the nearest items by codes, and `clusters_of` their edges."""
    v = cut(sound(items).withColumnRenamed("v", "embedding"))
    book = codebook if codebook is not None else train(v, parts, size, dim)
    return clusters_of(v, neighbour_edges(v, book, threshold, neighbours), threshold, ratio, cap, strict)
