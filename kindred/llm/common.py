"""Helpers shared by the operators: size-checked broadcasts, Arrow slicing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators import components as graph
from kindred.operators.lineage import PACK, bucketed, counted, cut, new_path, shared_dir

__all__ = ["PACK", "WORD", "bucketed", "components", "counted", "cut", "join_hot", "left_join_hot", "new_path", "shared_dir", "sliced", "small_side", "unused", "word_count"]

#: Java regular expression of one word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side may be broadcast, after its rows were counted.
BROADCAST_ROWS = 2_000
#: Rows of a key from which a join gives it to no single task; and how many such keys are broadcast at most.
HOT, HOT_KEYS = 20_000, 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (a table) with a broadcast hint if a count shows at most `rows` rows, else as it is (shuffle join)."""
    return F.broadcast(df) if df.count() <= rows else df


def hot_bar(rows: int) -> int:
    """Rows from which a key of a table of `rows` rows is hot: at most HOT_KEYS keys can have so many, and all others are under 1 / HOT_KEYS of the table."""
    return max(HOT, -(-rows // HOT_KEYS))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join of two tables, `right` with one row a key and how often the key comes in `n`, which is dropped.

    Hot keys are broadcast, so they stay where their rows are.
    """
    bar = hot_bar(right.agg(F.sum(n)).first()[0] or 0)
    hot = right.where(F.col(n) >= bar).drop(n)
    if hot.isEmpty():
        return left.join(right.drop(n), on)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(n) < bar).drop(n), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def left_join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of two tables on one column, `right` with one row a key; hot keys of `left` are broadcast."""
    bar = hot_bar(left.count())
    hot, found = counted(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= bar) & F.col(key).isNotNull()).select(key))
    if not found:
        return left.join(right, key, "left")
    many = right.join(F.broadcast(hot), key, "left_semi")
    return left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(many), key, "left").unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until `df` has no column of that name (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sliced(batches: Iterator[pa.RecordBatch], column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Each batch cut into runs of rows whose `column` (string or binary) holds about `budget` bytes, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()  # the pool would hold what the largest batch took


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected `edges`: (id, component), component being the smallest id reachable. Nulls are not edges."""
    return graph.components(edges.select(F.col(a).alias("i"), F.col(b).alias("j"))).toDF("id", "component")
