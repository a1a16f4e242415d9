"""Exact pair search on cosine distance: threshold self-join and top-k join.

Both compare blocks of an index of cells (`kindred.operators.cells`), and leave out what the triangle inequality of angles rules
out before rows are copied. A row that would visit so many blocks that a scan of all rows costs less is compared with all, in
parts of fixed size; where that holds for most, as with vectors in no clusters, parts meet pairwise and there are no cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.vectors import norm
from kindred.operators import cells as index
from kindred.operators.cells import BLOCK_COST, ROW_COST, Cells, copies, dealt, lengths, pieces, spread_out, vectors
from kindred.operators.lineage import cut

#: Vectors of one block at most, and rows of a block that are multiplied at once.
BLOCK, TILE = 8192, 256
#: Pairs that a task finds before it hands them on.
RUN = 1 << 17
#: Smaller blocks than this are not worth a task of their own.
LEAST = 128
#: Queries whose visits are estimated.
PROBES = 256


def sound(items: DataFrame) -> DataFrame:
    """(item_id, v) of the rows with a vector that is not null and not zero."""
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("embedding").alias("v")).where("item_id is not null and v is not null").where(norm("v") > 0)


def blocks_for(n: int, cores: int, block: int) -> int:
    """Number of blocks of at most about `block` of `n` rows each; more if that leaves cores without a pair of blocks."""
    return max(1, -(-n // block), min(-(-n // LEAST), math.isqrt(2 * cores)))


def _stack(p: pd.DataFrame) -> np.ndarray:
    return np.stack(p.v.to_list()).astype(np.float64)


def _parts(n: np.ndarray, block: int) -> np.ndarray:
    return np.maximum(1, -(-n // block))


class Join:
    """Which blocks the rows of a threshold self-join visit: each pair of blocks from the wider one to the other, if at all."""

    def __init__(self, cells: Cells, threshold: float):
        self.cells, self.least = cells, 1.0 - threshold
        self.rank = np.empty(len(cells.cell), np.int64)
        self.rank[np.lexsort((np.arange(len(cells.cell)), cells.high - cells.low))] = np.arange(len(cells.cell))

    def visits(self, d: np.ndarray, length: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Rows by blocks: whether rows with distances `d`, in blocks `own`, visit them."""
        c = self.cells
        # a pair under the threshold has a product over `least`, so an angle of this at most
        most = np.arccos(np.clip(self.least / (length[:, None] * (c.longest if self.least >= 0 else c.shortest)), -1, 1))
        fits = self.least / (length[:, None] * c.longest) <= 1 + index.SLACK if self.least >= 0 else True
        return (c.gaps(d) <= most + index.SLACK) & fits & (self.rank < self.rank[own][:, None])


def visit_costs(count: np.ndarray, block: int, weight: float = 1.0) -> tuple[np.ndarray, float]:
    """What a row's visit of each block costs, and what a scan of all rows does, if a comparison costs `weight` products of two vectors."""
    n = float(count.sum())
    return weight * count + ROW_COST * np.maximum(1, np.ceil(count / block)), weight * n + ROW_COST * max(1.0, np.ceil(n / block))


def flagged(rows: DataFrame, wide: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[DataFrame, DataFrame, int]:
    """`rows` that are not `wide`, those that are, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(wide(b))], names=[*b.schema.names, "wide"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = cut(rows.mapInArrow(run, f"{kinds}, wide boolean"))
    return out.where("not wide").drop("wide"), out.where("wide").drop("wide"), out.where("wide").count()


def _join_cost(sample: np.ndarray, n: int, threshold: float, block: int) -> Callable[[Cells], float]:
    scale = n / len(sample)

    def cost(c: Cells) -> float:
        # TILE rows of the sample at once: the driver holds several tables of rows by blocks
        runs = [sample[k : k + TILE] for k in range(0, len(sample), TILE)]
        known = np.unique(np.concatenate([c.block_of(c.distances(x))[0] for x in runs]))
        h, join = c.count * scale, Join(c, threshold)
        each, scan = visit_costs(h, block)

        def row_costs(x: np.ndarray) -> np.ndarray:
            d = c.distances(x)
            return np.minimum(join.visits(d, lengths(x), c.numbers(c.block_of(d)[0], known)) @ each, scan)

        rows = np.concatenate([row_costs(x) for x in runs]).sum() * scale
        return rows + (h * (h / 2 + ROW_COST * 2 * np.ceil(h / block)) + BLOCK_COST).sum()

    return cost


def pairs_plan(items: DataFrame, threshold: float, block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """The pairs (i, j, dist) of `pairs_within`, the number of vectors, and how many pairs of them are compared."""
    v = sound(items)
    n, cores = v.count(), v.sparkSession.sparkContext.defaultParallelism
    alone = lambda: (_alone(v, np.array([blocks_for(n, cores, block)]), threshold), n, n * (n - 1) // 2)
    if n <= block:
        return alone()
    v = cut(v)
    sample, read = index.sampled(v, "v"), lambda b: vectors(b.column("v"))
    cells = index.fitted(sample, True, _join_cost(sample, n, threshold, block))
    if len(cells.cell) == 1:
        return alone()

    def indexed(rows: DataFrame) -> tuple[Cells, Callable]:
        c, rings = index.measured(rows, cells, read)
        sent = v.sparkSession.sparkContext.broadcast((Join(c, threshold), rings))

        def visiting(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            j, known = sent.value
            x = vectors(b.column("v"))
            d = j.cells.distances(x)
            own = j.cells.numbers(j.cells.block_of(d)[0], known)
            return own, j.visits(d, lengths(x), own)

        return c, visiting

    c, visiting = indexed(v)
    each, scan = visit_costs(c.count, block)
    few, wide, k = flagged(v, lambda b: visiting(b)[1] @ each > scan)
    if k == n:
        return alone()
    if k:  # without those of many visits, blocks are narrower
        c, visiting = indexed(few)
    visitors = index.tallied(few, lambda b: np.nonzero(visiting(b)[1])[1], len(c.cell))
    out = _joined(few, visiting, _parts(c.count, block), _parts(visitors, block) * (visitors > 0), threshold)
    compared = int((c.count * (c.count - 1) // 2).sum() + (c.count * visitors).sum())
    if k:
        out = out.unionByName(_scanned(wide, few, blocks_for(k, cores, block), -(-n // block), threshold))
        compared += k * (k - 1) // 2 + k * (n - k)
    return out, n, compared


def rough(*sides: np.ndarray) -> list[np.ndarray]:
    """The same rows in single precision, or as they are if that would overflow."""
    high = max(_longest(x) for x in sides)
    return [x.astype(np.float32) if high < 1e15 else x for x in sides]


def _longest(x: np.ndarray) -> float:
    n = lengths(x)
    return float(n.max(initial=0, where=np.isfinite(n)))


def give(a: np.ndarray, b: np.ndarray) -> float:
    """What a product of rows of `a` and `b` in single precision may be wrong by, at most."""
    return (a.shape[1] + 8) * 1.2e-7 * _longest(a) * _longest(b)


def products(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the columns x of `a` with the columns y of `b`, added up in order, so that equal vectors have equal ones."""
    out = np.zeros(len(x))
    for u, w in zip(a, b, strict=True):
        out += u[x] * w[y]
    return out


def bound_of(d: np.ndarray, k: int) -> np.ndarray:
    """For each row of `d` a value that `k` of its entries at least do not exceed: the k-th of the least of groups of entries."""
    n = d.shape[1]
    if k >= n:
        return np.full(len(d), np.inf)
    w = n // max(4 * k, 64)
    if w > 1:
        d = d[:, : w * (n // w)].reshape(len(d), w, -1).min(axis=1)
    return np.partition(d, k - 1, axis=1)[:, k - 1].astype(np.float64)


def firsts(row: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` smallest (dist, id) of each row."""
    order = np.lexsort((ids, dist, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def _runs(a: pd.DataFrame, b: pd.DataFrame, threshold: float, once: bool) -> Iterator[pd.DataFrame]:
    """Pairs of a row of `a` and one of `b` under the threshold; with `once`, as both hold the same rows, those of the smaller id in `a`.

    Products in single precision leave out what is surely over it. Frames hold fewer than 2 * RUN pairs, so that blocks in which
    all is near take no more memory than others.
    """
    found, held = [pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "dist": np.zeros(0)})], 0
    if len(a) and len(b):
        va, vb, ia, ib = _stack(a), _stack(b), a.item_id.to_numpy(np.int64), b.item_id.to_numpy(np.int64)
        ra, rb = rough(va, vb)
        least = 1.0 - threshold - give(va, vb) - 1e-6 * abs(1.0 - threshold)
        va, vb = np.ascontiguousarray(va.T), np.ascontiguousarray(vb.T)
        for k in range(0, len(ra), TILE):
            near = np.flatnonzero(ra[k : k + TILE] @ rb.T > least)
            for at in range(0, len(near), RUN):
                x, y = np.divmod(near[at : at + RUN], len(rb))
                u, w = ia[k + x], ib[y]
                good = np.flatnonzero(u < w if once else u != w)
                d = 1.0 - products(va, k + x[good], vb, y[good])
                good, d = good[d < threshold], d[d < threshold]
                u, w = u[good], w[good]
                found.append(pd.DataFrame({"i": np.minimum(u, w), "j": np.maximum(u, w), "dist": d}))
                held += len(d)
                if held >= RUN:
                    yield pd.concat(found)
                    found, held = found[:1], 0
    yield pd.concat(found)


def _compared(a: pd.DataFrame, b: pd.DataFrame, threshold: float, once: bool) -> pd.DataFrame:
    """All frames of `_runs`."""
    return pd.concat(_runs(a, b, threshold, once))


PAIRS = "i long, j long, dist double"


def _alone(v: DataFrame, parts: np.ndarray, threshold: float) -> DataFrame:
    """All pairs, in parts that meet pairwise."""
    return _joined(v, lambda b: (np.zeros(b.num_rows, np.int64), None), parts, np.zeros(1, np.int64), threshold)


def _scanned(wide: DataFrame, few: DataFrame, parts: int, others: int, threshold: float) -> DataFrame:
    """Pairs of `wide` rows with each other and with all others, in parts."""

    def sent(rows: DataFrame, side: int, own: int, met: int) -> DataFrame:
        part = F.pmod(F.xxhash64("item_id"), F.lit(own)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(met - 1)))
        return rows.select(part.alias("i" if side == 0 else "j"), other.alias("j" if side == 0 else "i"), F.lit(side).alias("own"), "item_id", "v")

    right = few.select("item_id", "v")
    met = sent(wide, 0, parts, others).unionByName(sent(right, 1, others, parts))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(batches)
        yield from _runs(p[p.own == 0], p[p.own == 1], threshold, False)

    found = met.groupBy("i", "j").applyInPandas(compare, PAIRS)
    return found.unionByName(_alone(wide.select("item_id", "v"), np.array([parts]), threshold))


def _joined(v: DataFrame, visiting: Callable, parts: np.ndarray, guests: np.ndarray, threshold: float) -> DataFrame:
    """Pairs of the rows of each block with each other, in `parts` that meet pairwise, and with its visitors, in `guests` parts, which are numbered below 0.

    `visiting` tells a batch's blocks and visits (rows by blocks), None if there are none.
    """
    sent = v.sparkSession.sparkContext.broadcast((parts, guests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hp, vp = sent.value
        for b in pieces(batches):
            ids = b.column("item_id").to_numpy()
            own, visits = visiting(b)
            part = dealt(ids, hp[own])
            at, other = spread_out(hp[own])
            yield from copies(b, at, b=own[at], i=np.minimum(part[at], other), j=np.maximum(part[at], other), own=part[at])
            if visits is None:
                continue
            at, guest = spread_out(vp[own])
            yield from copies(b, at, b=own[at], i=part[at], j=-1 - guest, own=np.zeros(len(at), np.int64))
            row, to = np.nonzero(visits)
            at, host = spread_out(hp[to])
            place = dealt(ids[row], vp[to])
            yield from copies(b, row[at], b=to[at], i=host, j=-1 - place[at], own=np.ones(len(at), np.int64))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(batches)
        i, j = p.i.iloc[0], p.j.iloc[0]
        a, b = (p[p.own == 0], p[p.own == 1]) if j < 0 else (p[p.own == i], p[p.own == j])
        yield from _runs(a, b, threshold, i == j)

    kind = v.schema["v"].dataType.simpleString()
    met = v.select("item_id", "v").mapInArrow(run, f"b int, i int, j int, own int, item_id long, v {kind}")
    return met.groupBy("b", "i", "j").applyInPandas(compare, PAIRS)


def pairs_within(items: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(i, j, dist), i < j, of all pairs of unit vectors with cosine distance under `threshold` (strict).

    Vectors of other lengths count by 1 - product too. Memory of a task is that of two blocks. Beyond one block of rows, only
    pairs that the cells cannot rule out are compared; `compared_pairs` tells how many.
    """
    return pairs_plan(items, threshold, block)[0]


def compared_pairs(items: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """One row of what `pairs_within` would compare: (vectors, pairs, compared, share)."""
    _, n, compared = pairs_plan(items, threshold, block)
    return items.sparkSession.createDataFrame([(n, n * (n - 1) // 2, compared, compared / max(1, n * (n - 1) // 2))], "vectors long, pairs long, compared long, share double")


class Nearest:
    """Which blocks a query of a top-k search visits: first the nearest ones that hold enough, then all that may hold nearer ones than found."""

    def __init__(self, cells: Cells, k: int):
        self.cells, self.k = cells, k

    def bounds(self, d: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Least score of each row with each block: squared distance, or 1 - product."""
        c, gap = self.cells, self.cells.gaps(d)
        if not c.angular:
            return gap**2
        cos = np.cos(np.minimum(gap, np.pi))
        return 1 - length[:, None] * np.where(cos >= 0, c.longest, c.shortest) * cos - index.SLACK

    def first(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Rows by blocks: the visits of the first round, which reach `k` items besides the query."""
        order = np.argsort(bound + 1e-9 * d[:, self.cells.cell], axis=1, kind="stable")
        before = np.cumsum(self.cells.count[order], axis=1) - self.cells.count[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, before <= self.k, axis=1)
        return out


def _search_cost(sample: np.ndarray, probes: np.ndarray, n: int, queries: int, k: int, within: float | None, block: int, weight: float) -> Callable[[Cells], float]:
    many, scale = queries / len(probes), n / len(sample)

    def cost(c: Cells) -> float:
        if c.angular:
            score = 1 - probes @ sample.T
        else:
            score = (probes**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * probes @ sample.T
        near = np.partition(score, min(k, len(sample) - 1), axis=1)[:, min(k, len(sample) - 1)]
        d = c.distances(probes)
        s = Nearest(replace(c, count=np.maximum(1, c.count * scale).astype(np.int64)), k)
        bound = s.bounds(d, lengths(probes))
        early = s.first(d, bound)
        late = (bound <= (near if within is None else np.minimum(near, within))[:, None]) & ~early
        h = c.count * scale
        each, scan = visit_costs(h, block, weight)
        rows = (early @ each + np.minimum(late @ each, scan)).sum() * many
        return rows + (ROW_COST * h * np.ceil((early | late).sum(axis=0) * many / block) + BLOCK_COST).sum()

    return cost


def search(q: DataFrame, items: DataFrame, k: int, compare: Callable, payload: str, read: Callable[[pa.RecordBatch], np.ndarray], sample: Callable[[], np.ndarray], angular: bool, block: int, within: float | None = None, weight: float = 1.0) -> tuple[DataFrame, int]:
    """The `k` nearest `items` (item_id, payload) of every query (item_id, v) as (query_id, item_id, dist, rank), and how many distances that takes.

    `compare(queries, items, k)` makes (query_id, item_id, dist) of the k nearest of one group. `read` turns batches of items into
    vectors of the metric that dist follows: 1 - product if `angular`, else squared distance. With `within`, items further
    than that may be left out. `weight` is the cost of a comparison, see `visit_costs`.
    """
    out_schema, cores = "query_id long, item_id long, dist double", q.sparkSession.sparkContext.defaultParallelism
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "item_id"))
    nq, n = q.count(), items.count()
    if not nq or n <= block:
        found = _met(q, items, None, payload, compare, k, np.array([blocks_for(nq, cores, block)]), np.array([max(1, -(-n // block))]), out_schema)
        return found.withColumn("rank", rank).where(F.col("rank") <= k), nq * n
    q, items = cut(q), cut(items)
    probes, some = index.sampled(q, "v", PROBES), sample()
    cells = index.fitted(some, angular, _search_cost(some, probes, n, nq, k, within, block, weight))
    cells, rings = index.measured(items, cells, read)
    if len(rings) == 1:
        found = _met(q, items, None, payload, compare, k, np.array([blocks_for(nq, cores, block)]), _parts(np.array([n]), block), out_schema)
        return found.withColumn("rank", rank).where(F.col("rank") <= k), nq * n
    plan = Nearest(cells, k)
    sent = q.sparkSession.sparkContext.broadcast((plan, rings))

    def visits(b: pa.RecordBatch) -> np.ndarray:
        p, x = sent.value[0], vectors(b.column("v"))
        d = p.cells.distances(x)
        bound = p.bounds(d, lengths(x))
        early = p.first(d, bound)
        if "far" not in b.schema.names:
            return early
        return (bound <= b.column("far").to_numpy(zero_copy_only=False)[:, None]) & ~early

    def block_of(b: pa.RecordBatch) -> np.ndarray:
        p, known = sent.value
        return p.cells.numbers(p.cells.block_of(p.cells.distances(read(b)))[0], known)

    def met(some: DataFrame) -> tuple[DataFrame, int]:
        visitors = index.tallied(some, lambda b: np.nonzero(visits(b))[1], len(rings))
        parts = _parts(visitors, block) * (visitors > 0)
        found = _met(some, items, (visits, block_of), payload, compare, k, parts, _parts(cells.count, block), out_schema)
        return found, int((visitors * cells.count).sum())

    first, work = met(q)
    first = cut(first)
    # a query's k-th so far, not counting itself twice; of the blocks visited, each gave k rows at most
    worst = first.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"))
    far = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    limit = F.least(far, F.lit(float("inf") if within is None else within))
    again = cut(q.join(worst, F.col("item_id") == F.col("query_id"), "left").select("item_id", "v", F.coalesce(limit, F.lit(float("inf") if within is None else within)).alias("far")))
    each, scan = visit_costs(cells.count, block, weight)
    few, wide, many = flagged(again, lambda b: visits(b) @ each > scan)
    second, more = met(few)
    found = first.unionByName(cut(second))
    if many:  # queries near to nothing are held against all items, which makes what they found before unneeded
        whole = _met(wide, items, None, payload, compare, k, np.array([blocks_for(many, cores, block)]), _parts(np.array([n]), block), out_schema)
        found = found.join(wide.select(F.col("item_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    return found.withColumn("rank", rank).where(F.col("rank") <= k), work + more + many * n


def _met(q: DataFrame, items: DataFrame, route: tuple | None, payload: str, compare: Callable, k: int, qp: np.ndarray, ip: np.ndarray, schema: str) -> DataFrame:
    """Parts of visiting queries and parts of each block's items meet pairwise. `route`: functions that tell visits and blocks of a batch; one block if None."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, to = np.nonzero(route[0](b)) if route else (np.arange(b.num_rows), np.zeros(b.num_rows, np.int64))
            part = dealt(b.column("item_id").to_numpy()[row], qp[to])
            at, other = spread_out(ip[to])
            yield from copies(b.select(["item_id", "v"]), row[at], b=to[at], i=part[at], j=other)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            own = route[1](b) if route else np.zeros(b.num_rows, np.int64)
            part = dealt(b.column("item_id").to_numpy(), ip[own])
            at, other = spread_out(qp[own])
            yield from copies(b, at, b=own[at], i=other, j=part[at])

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "item_id": [], "dist": []}).astype({"query_id": "int64", "item_id": "int64"})
        return compare(x, y, k)

    left = q.mapInArrow(asked, f"b int, i int, j int, item_id long, v {q.schema['v'].dataType.simpleString()}")
    right = items.select("item_id", payload).mapInArrow(held, f"b int, i int, j int, item_id long, {payload} {items.schema[payload].dataType.simpleString()}")
    return left.groupBy("b", "i", "j").cogroup(right.groupBy("b", "i", "j")).applyInPandas(near, schema)


def _nearest(x: pd.DataFrame, y: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of each query, from those that products in single precision leave."""
    ids, vy, vx, ix, out = y.item_id.to_numpy(), _stack(y), _stack(x), x.item_id.to_numpy(), []
    (rx, ry), slack = rough(vx, vy), 2 * give(vx, vy) + 1e-6
    wrong = np.flatnonzero(~np.isfinite(lengths(vy)))
    vx, vy = np.ascontiguousarray(vx.T), np.ascontiguousarray(vy.T)
    for at in range(0, len(rx), TILE):
        d = rx[at : at + TILE] @ ry.T
        np.negative(d, out=d)
        d[:, wrong] = np.inf
        r, c = np.nonzero(d <= (bound_of(d, k + 1) + slack)[:, None])  # the query may be one of them
        dist = 1.0 - products(vx, at + r, vy, c)
        good = (ix[at + r] != ids[c]) & np.isfinite(dist)
        r, c, dist = r[good], c[good], dist[good]
        some = firsts(r, dist, ids[c], k)
        out.append(pd.DataFrame({"query_id": ix[at + r[some]], "item_id": ids[c[some]], "dist": dist[some]}))
    return pd.concat(out).astype({"query_id": "int64", "item_id": "int64"})


def top_k_plan(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """`top_k` and the number of distances it takes."""
    q, v = sound(queries), sound(items)
    return search(q, v, k, _nearest, "v", lambda b: vectors(b.column("v")), lambda: index.sampled(v, "v"), True, block)


def top_k(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, dist, rank) of the k nearest items of each query by cosine distance, self left out, ties to smaller ids."""
    return top_k_plan(queries, items, k, block)[0]
