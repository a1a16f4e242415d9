"""Consecutive numbers and running sums over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.lineage import cut


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """`df` with, for each name in `sums`, the sum of that column over all rows before a row in `order` (0 before the first).

    `order` must tell all rows apart for reruns to agree. Rows are dealt by range; each range sums its own rows, and the
    totals of the ranges before it (one row a range) are added.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = parts.groupBy("__part").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    ranges = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(totals.select("__part", *(F.coalesce(F.sum(f"__{k}").over(ranges), F.lit(0)).alias(f"__{k}") for k in sums)))  # one row a partition
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumns({f"__own_{k}": F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in sums.items()})
    return own.join(F.broadcast(starts), "__part").select(*df.columns, *((F.col(f"__{k}") + F.col(f"__own_{k}")).alias(k) for k in sums))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `name long`, 0, 1, 2, ... in `order`."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")})
