"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column | str) -> Column:
    """v / |v|; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - a . b, for unit vectors."""
    return F.lit(1.0) - dot(a, b)


def part(v: Column | str, m: int | Column, width: int) -> Column:
    """The m-th run of `width` components, from 0."""
    return F.slice(v, F.lit(m) * width + 1, F.lit(width))
