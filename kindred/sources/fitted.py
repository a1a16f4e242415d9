"""Codebooks and neighbour lists that are kept with a fingerprint of the vectors and parameters they were fitted on.

A saved table is a version with its number of rows and a checksum of them. What is missing, truncated, damaged, half written or
of another fingerprint counts as absent, so that it is fitted again; a save never touches what readers may still use.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.commits import Versions

CODEBOOK = "m int, k int, centroid array<double>"
NEIGHBOURS = "i long, j long"


def fingerprint(items: DataFrame, **parameters) -> str:
    """A string that changes with any id or component of `items` (item_id, embedding), their number, or any parameter; not with row order."""
    h = F.xxhash64("item_id", "embedding")
    other = F.xxhash64(F.lit(7), F.col("item_id"), F.col("embedding"))
    r = items.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(other).alias("x")).first()
    return f"{r.n}:{r.s}:{r.x}:{json.dumps(parameters, sort_keys=True)}"


def _checked(df: DataFrame) -> list[str]:
    """Number and checksum of the rows, whatever their order."""
    h = F.xxhash64(*df.columns)
    other = F.xxhash64(F.lit(3), *df.columns)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(other).alias("x")).first()
    return [str(r.n), str(r.s), str(r.x)]


def _save(df: DataFrame, path: str, schema: str, mark: str) -> None:
    versions = Versions(df.sparkSession, path)
    folder = versions.new_data()
    df.select(*(x.split()[0] for x in schema.split(", "))).write.parquet(folder)
    sums = _checked(df.sparkSession.read.schema(schema).parquet(folder))
    versions.commit(lambda number, base: {"fingerprint": mark, "folder": folder, "sums": sums})


def _load(spark: SparkSession, path: str, schema: str, mark: str) -> DataFrame | None:
    found = Versions(spark, path).latest()[1] or {}
    if found.get("fingerprint") != mark:
        return None
    try:
        table = spark.read.schema(schema).parquet(found["folder"])
        return table if _checked(table) == found["sums"] else None
    except (PySparkException, Py4JJavaError, KeyError):  # files gone or damaged
        return None


def vacuum(spark: SparkSession, path: str, keep: int = 1, age: float = 86_400.0) -> int:
    """Deletes older saves at `path`; see `Versions.vacuum`."""
    return Versions(spark, path).vacuum(lambda m: {m["folder"]} if "folder" in m else set(), keep, age)


def save_codebook(codebook: DataFrame, path: str, mark: str) -> None:
    _save(codebook, path, CODEBOOK, mark)


def load_codebook(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """The codebook at `path`, or None if there is none or it was saved under another fingerprint."""
    return _load(spark, path, CODEBOOK, mark)


def save_neighbours(pairs: DataFrame, path: str, mark: str) -> None:
    _save(pairs, path, NEIGHBOURS, mark)


def load_neighbours(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """(i, j) at `path`, or None if there are none or they were saved under another fingerprint."""
    return _load(spark, path, NEIGHBOURS, mark)
