"""Cutting lineage in iterative operators by tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows that one task reads of a packed table at most.
PACK = 100_000

_made: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on a local master; on a cluster that raises."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder; `release` removes what was written there."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame, pack: int = 0) -> DataFrame:
    """The same rows with their lineage cut by a table in the shared folder.

    Unlike a checkpoint's, its plan has none of the constraints that Catalyst infers, which iterations let grow without end.
    With `pack` (for narrow rows), later stages read it in as few tasks as hold `pack` rows each, so that small tables of
    many partitions do not leave a shuffle file for every pair of tasks.
    """
    return counted(df, pack)[0] if pack else _written(df)


def counted(df: DataFrame, pack: int = PACK) -> tuple[DataFrame, int]:
    """`cut` and the number of rows."""
    out = _written(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // pack))), n


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The same rows as a table of the session's catalog in the shared folder, dealt and sorted by `key`: joins on it do not shuffle it.

    `df` should be dealt by `key` already, as an aggregate by it is: each bucket is then one file.
    """
    spark = df.sparkSession
    path = new_path(spark, "buckets")
    name = f"kindred_{path.rpartition('-')[2]}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def release(spark: SparkSession, made: int = 0, tables: int = 0) -> None:
    """Deletes what was written to the shared folder so far (after the first `made` paths and `tables` tables). Results are lazy: call it when none is read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_tables) > tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while len(_made) > made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end, and nothing else; results must be written elsewhere by then."""
    made, tables = len(_made), len(_tables)
    try:
        yield
    finally:
        release(spark, made, tables)
