"""Connected components of a graph of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.lineage import PACK, counted, cut

#: Edges that a task turns into stars at once.
RUN_EDGES = 1 << 18


def local_stars(edges: DataFrame) -> DataFrame:
    """Edges (i, j) that connect what `edges` (i, j) connects: those of each run of a partition become stars around its smallest ids.

    Memory is that of one run of RUN_EDGES edges; no shuffle.
    """

    def stars(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b, low = at[: len(i)], at[len(i) :], np.arange(len(ids))
        while True:
            x, y = low[a], low[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (low[low] != low).any():
                low = low[low]
        leaf = np.flatnonzero(low != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[low[leaf]]), pa.array(ids[leaf])], names=["i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= RUN_EDGES:
                yield stars(*(np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1)))
                held = []
        if held:
            yield stars(*(np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1)))

    return edges.where("i is not null and j is not null").select(F.col("i").cast("long"), F.col("j").cast("long")).mapInArrow(run, "i long, j long")


def components(edges: DataFrame) -> DataFrame:
    """(item_id, label) of every item on an edge (i, j) with i <> j: the smallest id it is connected with. Nulls are no edges.

    Edges shrink to stars inside partitions first, so small graphs are done after one round. A round names each item after the
    smallest around it (after the first round, by seeded hash, so that chains shrink by a constant factor too) and keeps the
    edges between names. Only counts reach the driver.
    """
    e, n = counted(local_stars(edges.where("i <> j")))
    empty, labels, turn = e, None, 0
    while n:
        s = local_stars(e)
        both = s.select(F.col("i").alias("n"), F.col("i").alias("m")).unionByName(s.select(F.col("j").alias("n"), F.col("i").alias("m"))).unionByName(s.select(F.col("i").alias("n"), F.col("j").alias("m")))
        order = F.xxhash64("m", F.lit(turn)) if turn else F.col("m")
        low = cut(both.groupBy("n").agg(F.min(F.struct(order.alias("h"), "m")).alias("x")).select("n", F.col("x.m").alias("m")), PACK)
        if labels is None:
            labels = low.toDF("item_id", "label")
        else:
            labels = cut(labels.join(low, labels["label"] == low["n"], "left").select("item_id", F.coalesce("m", "label").alias("label")), PACK)
        step = e.join(low.toDF("i", "a"), "i").join(low.toDF("j", "b"), "j")
        e, n = counted(local_stars(step.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).where("i < j")))
        turn += 1
    if labels is None:
        return empty.toDF("item_id", "label")
    if turn == 1:  # names are smallest ids
        return labels
    least = labels.groupBy("label").agg(F.min("item_id").alias("least"))
    return cut(labels.join(cut(least, PACK), "label").select("item_id", F.col("least").alias("label")), PACK)
