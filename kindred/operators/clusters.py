"""Clustering of a graph of distances: components, size-constrained merging, average linkage and the split of large clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.components import components
from kindred.operators.lineage import counted, cut
from kindred.operators.numbering import numbered
from kindred.operators.pairs import LEAST, TILE, bound_of, firsts, give, products, rough

#: Weak edges merge two clusters only up to this many members.
WEAK_CAP = 50
#: Weak edges of one component that one task merges at most; larger components take rounds first.
TASK_EDGES = 200_000
#: Edges among the first TASK_EDGES of a larger component that are drawn to tell where these end.
PLACES = 1_000
#: Edges whose numbers a task holds as objects at once.
RUN = 1 << 14


def renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(item_id, label) with the labels of `names` (label, merged) renamed."""
    return cut(labels.join(names, "label", "left").select("item_id", F.coalesce("merged", "label").alias("label")))


def _merged(edges: pd.DataFrame, cap: int, strong: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The ends of `edges` (a, b, dist, i, j, na, nb) and the smallest id that each hangs together with, once they are merged in order; na and nb count members (missing: no item)."""
    ids, at = np.unique(np.concatenate([edges.a.to_numpy(), edges.b.to_numpy()]), return_inverse=True)
    sizes = np.concatenate([edges.na.to_numpy(np.float64), edges.nb.to_numpy(np.float64)])
    n = np.full(len(ids), np.nan)
    n[at[~np.isnan(sizes)]] = sizes[~np.isnan(sizes)]
    item, n, root = (~np.isnan(n)).tolist(), np.nan_to_num(n).tolist(), list(range(len(ids)))
    order = np.lexsort((edges.j.to_numpy(), edges.i.to_numpy(), edges.dist.to_numpy()))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(0, len(order), RUN):
        some = order[k : k + RUN]
        for x, y, d in zip(at[some].tolist(), at[len(order) + some].tolist(), edges.dist.to_numpy()[some].tolist(), strict=True):
            known = item[x] and item[y]
            x, y = sorted((find(x), find(y)))
            if x != y and (d < strong or known and n[x] + n[y] <= cap):
                root[y] = x
                n[x] += n[y]
    return ids, ids[[find(x) for x in range(len(ids))]]


def _small_graph(ids: DataFrame, e: DataFrame, strong: float, cap: int) -> DataFrame:
    """`constrained_clusters` of few edges `e`, by one task; items without edges do not take part."""
    ends = e.select(F.col("i").alias("item_id")).unionByName(e.select(F.col("j").alias("item_id"))).distinct()
    own = F.broadcast(ids.join(F.broadcast(ends), "item_id", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))
    known = e.join(own.toDF("i", "na"), "i", "left").join(own.toDF("j", "nb"), "j", "left").withColumn("g", F.lit(0))

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        ids, labels = _merged(p.assign(a=p.i, b=p.j), cap, strong)
        return pd.DataFrame({"item_id": ids, "label": labels})

    names = F.broadcast(known.groupBy("g").applyInPandas(merge, "item_id long, label long"))
    return cut(ids.join(names, "item_id", "left").select("item_id", F.coalesce("label", "item_id").alias("label")))


def constrained_clusters(items: DataFrame, edges: DataFrame, threshold: float, ratio: float = 0.7, cap: int = WEAK_CAP, most: int = TASK_EDGES) -> DataFrame:
    """(item_id, label): edges in order of (dist, i, j) merge if dist < ratio * threshold, or else if both clusters hold `cap` members at most.

    Up to `most` edges are merged by one task. Of more, close edges come first, so they form plain components. Of the weak ones only
    the first between two components counts, and components of the contracted weak graph do not touch each other: each is merged
    on its own. While one has over `most` edges, a round decides about the first `most` of them in order, as nothing after
    them matters to those; the rest takes the new names, and loses the edges whose clusters are too large together by then.
    The label is the smallest id.
    """
    if ratio > 1:
        raise ValueError("ratio must be at most 1")
    e, n = counted(edges.select("i", "j", "dist"))
    ids = items.select(F.col("item_id").cast("long").alias("item_id"))
    if n <= most:
        return _small_graph(ids, e, ratio * threshold, cap)
    dense = components(e.where(F.col("dist") < ratio * threshold))
    base = cut(ids.join(dense, "item_id", "left").select("item_id", F.coalesce("label", "item_id").alias("label")))
    sizes = base.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    weak = e.where(F.col("dist") >= ratio * threshold)
    named = weak.join(base.toDF("i", "a"), "i").join(base.toDF("j", "b"), "j").where("a <> b")
    first = named.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("dist", "i", "j")).alias("e"))
    first = first.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(F.col("na") + F.col("nb") <= cap)
    first = cut(first.select("a", "b", "na", "nb", "e.*"))
    whole = components(first.select(F.col("a").alias("i"), F.col("b").alias("j"))).toDF("a", "g")

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        ids, names = _merged(p, cap)
        return pd.DataFrame({"label": ids, "merged": names})

    decided = lambda some: some.select("g", "a", "b", "na", "nb", "dist", "i", "j").groupBy("g").applyInPandas(merge, "label long, merged long")
    left = cut(first.join(whole, "a"))
    key = F.struct("dist", "i", "j")
    while True:
        large, n = counted(left.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most))
        small = left.join(large.select("g"), "g", "left_anti") if n else left
        base = renamed(base, decided(small))
        if not n:
            return base
        # the place of the first `most` edges is told by a sample, of which they hold some PLACES however many the component has
        left = cut(left.join(large.select("g"), "g").withColumn("e", key))
        rate = max(1, most // PLACES)
        place = F.row_number().over(Window.partitionBy("g").orderBy("e"))
        drawn = left.where(F.pmod(F.xxhash64("i", "j"), F.lit(rate)) == 0).select("g", "e", place.alias("place"))
        ends = drawn.where(F.col("place") <= most // rate).groupBy("g").agg(F.max("e").alias("end"))
        # a component that the sample passed over decides its first edge
        ends = left.groupBy("g").agg(F.min("e").alias("least")).join(ends, "g", "left").select("g", F.coalesce("end", "least").alias("end"))
        left = left.join(cut(ends), "g")
        names = cut(decided(left.where(F.col("e") <= F.col("end"))))
        base = renamed(base, names)
        sizes = cut(base.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
        x, y = names.toDF("a", "ma"), names.toDF("b", "mb")
        moved = left.where(F.col("e") > F.col("end")).join(x, "a", "left").join(y, "b", "left").select("g", F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"), "e").where("a <> b")
        moved = moved.groupBy("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
        moved = moved.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(F.col("na") + F.col("nb") <= cap)
        left = cut(moved.select("a", "b", "na", "nb", "e.*", "g"))


def _nearest_items(active: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """What `_nearest_clusters` tells of clusters of one item each, from all pairs under the threshold."""
    e = edges.where(F.col("dist") < threshold)
    ways = e.select(F.col("i").alias("label"), F.col("j").alias("to"), "dist").unionByName(e.select(F.col("j").alias("label"), F.col("i").alias("to"), "dist"))
    nearest = ways.groupBy("label").agg(F.min(F.struct(F.col("dist").alias("d"), "to")).alias("x"))
    return nearest.join(active.select("label"), "label", "left_semi").select("label", "x.to", "x.d")


def _nearest_clusters(active: DataFrame, threshold: float, block: int, edges: DataFrame | None = None) -> DataFrame:
    """(label, to, d): the nearest other cluster of the same g under `threshold` (ties to the smallest label), of rows with `again` that have any.

    Blocks of those rows meet blocks of all clusters of the component; memory of a task is that of two blocks. While clusters are
    items, `edges` (i, j, dist), all pairs under the threshold, tell it without.
    """
    if edges is not None:
        return _nearest_items(active, edges, threshold)
    few = F.lit(math.isqrt(2 * active.sparkSession.sparkContext.defaultParallelism))
    blocks = lambda n: F.greatest(F.ceil(n / block), F.least(F.ceil(n / LEAST), few)).cast("int")
    parts = cut(active.groupBy("g").agg(blocks(F.count(F.lit(1))).alias("parts"), blocks(F.count_if("again")).alias("asked")))
    own = active.join(parts, "g").withColumn("own", F.pmod(F.xxhash64("label"), F.col("parts")).cast("int"))
    ask = F.pmod(F.xxhash64("label", F.lit(1)), F.greatest("asked", F.lit(1))).cast("int")
    left = own.where("again").select("g", ask.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("asks"), "label", "s", "n")
    right = own.where("asked > 0").select("g", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"), "label", "s", "n")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("label")
        x, y = p[p.asks], p[~p.asks]
        if x.empty or y.empty:
            return pd.DataFrame({"label": [], "to": [], "d": []})
        u, w = x.label.to_numpy(), y.label.to_numpy()
        v, z = (np.stack(t.s.to_list()) / t.n.to_numpy()[:, None] for t in (x, y))
        (rv, rz), slack, out = rough(v, z), 2 * give(v, z) + 1e-9, []
        v, z = np.ascontiguousarray(v.T), np.ascontiguousarray(z.T)
        for at in range(0, len(rv), TILE):
            d = rv[at : at + TILE] @ rz.T
            np.negative(d, out=d)
            # one of the two nearest may be the cluster itself
            r, c = np.nonzero(d <= np.minimum(bound_of(d, 2) + slack, threshold - 1 + slack)[:, None])
            r, c = (k[u[at + r] != w[c]] for k in (r, c))
            # products are one value for both directions and do not hang on a place in a block
            exact = 1.0 - products(v, at + r, z, c)
            best = firsts(r, exact, w[c], 1)
            out.append(pd.DataFrame({"label": u[at + r[best]], "to": w[c[best]], "d": exact[best]}))
        out = pd.concat(out)
        return out[out.d < threshold]

    found = left.unionByName(right).groupBy("g", "i", "j").applyInPandas(compare, "label long, to long, d double")
    return found.groupBy("label").agg(F.min(F.struct("d", "to")).alias("x")).select("label", "x.to", "x.d")


def average_linkage(items: DataFrame, edges: DataFrame, threshold: float, most: int = 5_000, block: int = 32_768) -> DataFrame:
    """(item_id, label) of average-linkage clustering of `items` (item_id, embedding) under `threshold`; label: smallest id.

    A merge needs a pair under the threshold, so components of `edges` (all pairs under it) are clustered each on their own.
    The average distance of two clusters is that of their mean vectors. While a component holds over `most` clusters, rounds
    merge clusters that are each other's nearest, which leaves the result as it is: merged clusters are no nearer to a third
    than the nearer of both was; for that reason also only merged clusters, and those whose nearest was merged, look for their
    nearest again. The first round takes the nearest from `edges`. Clusters without another under the threshold are done. The rest is merged in one task a component.
    """
    edges = cut(edges.select("i", "j", "dist").where("i <> j and dist is not null"))
    named = cut(components(edges))
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "embedding")

    def link(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("label")
        n, owner = p.n.to_numpy().astype(np.float64), np.arange(len(p))
        x = np.stack(p.s.to_list()).astype(np.float64) / n[:, None]
        d = 1.0 - x @ x.T
        np.fill_diagonal(d, np.inf)
        to = d.argmin(axis=1)  # nearest of each, kept up to date, so that a merge does not look at the whole matrix
        low = d[np.arange(len(p)), to]
        while True:
            a = int(low.argmin())
            if not low[a] < threshold:
                break
            a, b = sorted((a, int(to[a])))
            row = (d[a] * n[a] + d[b] * n[b]) / (n[a] + n[b])
            d[a], d[:, a] = row, row
            d[b], d[:, b], d[a, a] = np.inf, np.inf, np.inf
            n[a] += n[b]
            owner[owner == b] = a
            nearer = (row < low) | ((row == low) & (a < to))
            again = np.flatnonzero((to == a) | (to == b))
            to[nearer], low[nearer] = a, row[nearer]
            again = np.union1d(again, [a, b])
            to[again] = d[again].argmin(axis=1)
            low[again] = d[again, to[again]]
        return pd.DataFrame({"label": p.label, "merged": p.label.to_numpy()[owner]})

    labels = cut(own.select("item_id", F.col("item_id").alias("label")))
    active = cut(
        own.join(named.withColumnRenamed("label", "g"), "item_id").select("g", F.col("item_id").alias("label"), F.col("embedding").cast("array<double>").alias("s"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("again"))
    )
    near = None  # the nearest of each cluster that is not asked again
    while True:
        large, many = counted(active.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select("g"))
        small = active.join(large, "g", "left_anti") if many else active
        labels = renamed(labels, small.drop("again").groupBy("g").applyInPandas(link, "label long, merged long"))
        if not many:
            return labels
        active = cut(active.join(large, "g", "left_semi"))
        found = _nearest_clusters(active, threshold, block, edges if near is None else None)
        near = cut(found if near is None else near.unionByName(found))
        back = near.select(F.col("label").alias("to"), F.col("to").alias("label"))
        names = cut(near.join(back, ["label", "to"]).where("to < label").select("label", F.col("to").alias("merged")))
        labels = renamed(labels, names)
        # what neither merged nor had its nearest merge keeps it: merged clusters come no nearer
        gone = cut(names.select("label").unionByName(names.select(F.col("merged").alias("label"))))
        asked = near.join(gone, near["to"] == gone["label"], "left_semi").select("label").unionByName(gone).distinct().withColumn("again", F.lit(True))
        moved = active.drop("again").join(near.select("label"), "label", "left_semi").join(names, "label", "left")
        moved = moved.select("g", F.coalesce("merged", "label").alias("label"), "s", "n", F.col("merged").isNotNull().alias("away"))
        stay, away = cut(moved.where("not away").drop("away")), cut(moved.where("away").select("label", F.col("s").alias("t"), F.col("n").alias("m")))
        both = stay.join(away, "label", "left").join(cut(asked), "label", "left")
        sums = F.when(F.col("m").isNull(), F.col("s")).otherwise(F.zip_with("s", "t", lambda x, y: x + y))
        active = cut(both.select("g", "label", sums.alias("s"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.coalesce("again", F.lit(False)).alias("again")))
        near = near.join(active.where("not again").select("label"), "label", "left_semi")


def split_oversize(labels: DataFrame, cap: int = 50) -> DataFrame:
    """Members of clusters over `cap` become clusters of their own: their label turns into their id (labels are smallest ids)."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(sizes, "label").select("item_id", F.when(F.col("n") > cap, F.col("item_id")).otherwise(F.col("label")).alias("label"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(label, members, pairs) of every cluster."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    return n.withColumn("pairs", (F.col("members") * (F.col("members") - 1) / 2).cast("long"))


def cluster_totals(labels: DataFrame) -> DataFrame:
    """One row: clusters, those of two members or more, all pairs inside clusters, and the next free label (0 if there is none)."""
    n = cluster_sizes(labels)
    return n.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("members") > 1).alias("groups"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.max("label") + 1, F.lit(0)).alias("next_label")
    )


def largest_clusters(labels: DataFrame, over: int = 100, most: int = 5) -> DataFrame:
    """(label, members, pairs) of the `most` largest clusters of more than `over` members, a report."""
    return cluster_sizes(labels).where(F.col("members") > over).orderBy(F.desc("members"), "label").limit(most)


def dense_labels(labels: DataFrame) -> DataFrame:
    """Labels renumbered from 0 in order, over the distinct labels."""
    order = numbered(labels.select("label").distinct(), ["label"], "rank")
    return labels.join(order, "label").select("item_id", F.col("rank").alias("label"))
