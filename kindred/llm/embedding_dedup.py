"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order. Inverted lists of reference points retrieve the vectors
that share some; what meets in a list is verified by cosine in double precision. Reference points and the length of prefixes
are fitted on a bounded sample: points keep apart, so that a dense region holds few of them, and prefixes are so long that
pairs at the very threshold share enough points. Equal vectors are one class, so copies do not meet each other. A pair is
counted in the list of the smallest reference point it shares, so once. Lists that are long, as reference points are bounded,
are parted by the second smallest shared point, so that they too need no other pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import PACK, components, cut, small_side

#: Reference points: four times the root of the number of vectors, within these bounds.
FEWEST, MOST = 16, 4096
#: Vectors of the sample that the index is fitted on, those of them that are probed, and pairs of these that are linked.
SAMPLE, PROBES, PAIRS = 4096, 1024, 20_000
#: Largest cosines of two reference points that the fit tries; the first keeps all apart from none.
APART = (2.0, 0.9, 0.8, 0.7, 0.6, 0.45, 0.3)
#: Reference points that a candidate pair shares, and how many more than the hardest probe needs describe a vector.
SHARED, MARGIN = 2, 2
#: What a row of a list costs besides comparisons, in comparisons: once, and for each point of its prefix.
ROW_COST, POINT_COST = 1e4, 1e2
#: Vectors of one list that meet in one block.
BLOCK = 1024
#: Vectors from which a list is parted by a second reference point.
LONG = 16 * BLOCK
#: Lists up to which their sizes are broadcast.
LISTS = 200_000


def usable(v: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def reference_points(classes: DataFrame, seed: int = 7) -> np.ndarray:
    """A bounded number of vectors of smallest seeded hash, as unit vectors."""
    n = min(MOST, max(FEWEST, int(4 * classes.count() ** 0.5)))
    rows = classes.select("v", F.xxhash64("cls", F.lit(seed)).alias("h")).orderBy("h").limit(n).collect()
    return unit(np.array([r.v for r in rows], np.float64)) if rows else np.zeros((0, 1))


def thinned(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first `most` rows of `sample` of which no two have a cosine of `apart` or more."""
    kept, near = [0], sample @ sample[0]
    for i in range(1, len(sample)):
        if len(kept) == most:
            break
        if near[i] < apart:
            kept.append(i)
            near = np.maximum(near, sample @ sample[i])
    return sample[kept]


def places(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The place of every reference point in the order by nearness of every row."""
    order = np.argsort(-(x @ points.T), axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(len(points))[None], axis=1)
    return out


def probe_pairs(x: np.ndarray, least: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors for the fit: linked ones among `x`, and each row of `x` with two vectors at cosine `least` of it.

    One of the two lies towards another row, so within the directions the table has, the other in a random direction.
    """
    rng = np.random.default_rng(seed)
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    some = rng.permutation(len(a))[:PAIRS]
    left, right = [x[a[some]]], [x[b[some]]]
    for towards in (x[rng.permutation(len(x))], rng.normal(size=x.shape)):
        across = towards - (towards * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(across, axis=1)
        good = length > 1e-6
        left.append(x[good])
        right.append(least * x[good] + np.sqrt(max(0.0, 1 - least**2)) * across[good] / length[good, None])
    return np.concatenate(left), np.concatenate(right)


def fit_index(classes: DataFrame, least: float, shared: int = SHARED, seed: int = 7) -> tuple[np.ndarray, int]:
    """Reference points and prefix length by which all probes share `shared` points, at the least cost estimated on the sample."""
    n = classes.count()
    rows = classes.select("v", F.xxhash64("cls", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 1)), 0
    sample = unit(np.array([r.v for r in rows], np.float64))
    x = sample[:PROBES]
    left, right = probe_pairs(x, least, seed)
    best = None
    for apart in APART:
        p = thinned(sample, min(MOST, max(FEWEST, int(4 * n**0.5))), apart)
        need, length = min(shared, len(p)), 1
        for k in range(0, len(left), 2048):
            later = np.maximum(places(left[k : k + 2048], p), places(right[k : k + 2048], p))
            length = max(length, 1 + int(np.partition(later, need - 1, axis=1)[:, need - 1].max()))
        length = min(length + MARGIN, len(p))
        share = np.bincount(np.nonzero(places(x, p) < length)[1], minlength=len(p)) / len(x)
        cost = n * n * (share**2).sum() / 2 + n * length * (ROW_COST + POINT_COST * length)
        if best is None or cost < best[0]:
            best = cost, p, length
    return best[1], best[2]


def prefixes(classes: DataFrame, points: np.ndarray, length: int) -> DataFrame:
    """`classes` (cls, v, weight) with `prefix array<int>`: its nearest reference points, nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(points)  # at most MOST vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                b = whole.slice(k, 2048)
                near = np.argsort(-(unit(matrix(b.column("v"))) @ p.T), axis=1, kind="stable")[:, :length].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=[*b.schema.names, "prefix"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kinds}, prefix array<int>")


def _two_smallest(x: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and second smallest of each row; rows may hold `none` for missing values."""
    two = np.sort(x, axis=1)[:, :2]
    return two[:, 0], two[:, 1] if two.shape[1] > 1 else np.full(len(two), none)


def _block_links(p: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one block of one list: for each linked class, the smallest class it hangs together with and the weight of its links."""
    same = p.i.iloc[0] == p.j.iloc[0]
    left = p[p.own == p.i.iloc[0]]
    right = left if same else p[p.own == p.j.iloc[0]]
    x, y = unit(np.stack(left.v.to_list()).astype(np.float64)), unit(np.stack(right.v.to_list()).astype(np.float64)) if len(right) else np.zeros((0, 1))
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    a, b = np.nonzero(x @ y.T >= least)
    if same:
        a, b = a[a < b], b[a < b]
    px, py, own, second = np.stack(left.prefix.to_list()), np.stack(right.prefix.to_list()), p["pivot"].iloc[0], p["second"].iloc[0]
    none = np.iinfo(np.int32).max
    good = np.zeros(len(a), bool)
    for k in range(0, len(a), 50_000):
        u, w = px[a[k : k + 50_000]], py[b[k : k + 50_000]]
        both = (u[:, :, None] == w[:, None, :]).any(axis=2)
        one, two = _two_smallest(np.where(both, u, none), none)
        good[k : k + 50_000] = (one == own) & ((second < 0) | (two == second))
    a, b = a[good], b[good]
    ids = np.concatenate([left.cls.to_numpy(), right.cls.to_numpy()])
    weight = np.concatenate([left.weight.to_numpy(), right.weight.to_numpy()])
    b = b if same else b + len(left)
    n = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    low = ids.copy()
    while True:  # smallest class that each hangs together with, by this block's links
        was = low.copy()
        np.minimum.at(low, a, was[b])
        np.minimum.at(low, b, low[a])
        if (low == was).all():
            break
    hit = np.flatnonzero(n)
    return pd.DataFrame({"a": ids[hit], "b": low[hit], "n": n[hit].astype(np.int64)})


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, shared: int = SHARED) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs found with cosine >= `least`, none below it.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are components of their own.
    Equal vectors are linked (their cosine is 1). Rows that repeat an id with equal vectors count once, as links of others,
    and are answered each. All vectors have one length. Null ids stand for themselves. kept: the id is its component's smallest.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable(v) & F.col(id_col).isNotNull(), v).alias("v"))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("cls"), F.count_distinct("id").alias("weight")).select("cls", "v", "weight"))
    points, length = fit_index(classes, least, shared)
    links, labels = None, None
    if len(points):
        listed = cut(prefixes(classes, points, length).withColumn("pivot", F.explode("prefix")))
        long = F.broadcast(cut(listed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG).select("pivot")))  # at most MOST rows
        short = listed.join(long, "pivot", "left_anti").withColumn("second", F.lit(-1))
        # pairs share two points or more by the fit, so those of a long list also share their second smallest
        parted = listed.join(long, "pivot").withColumn("second", F.explode(F.filter("prefix", lambda x: x > F.col("pivot"))) if min(shared, length) > 1 else F.lit(-1))
        listed = short.unionByName(parted)
        sizes = cut(listed.groupBy("pivot", "second").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
        own = listed.join(small_side(sizes, LISTS), ["pivot", "second"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = met.select("pivot", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "v", "weight", "prefix")
        links = cut(met.groupBy("pivot", "second", "i", "j").applyInPandas(lambda p: _block_links(p, least), "a long, b long, n long"), PACK)
        labels = components(links)
    by_class = classes.select("cls", "v", "weight")
    if links is not None:
        degree = links.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
        by_class = by_class.join(degree, "cls", "left").join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    else:
        by_class = by_class.withColumns({"n": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    found = cut(by_class.select(F.col("v").alias("cv"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component")))
    out = rows.join(found, F.col("v") == F.col("cv"), "left")
    own_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), F.coalesce(F.col("id") == own_id, F.lit(False)).alias("kept"))
