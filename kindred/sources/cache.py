"""Caches of computed values as Parquet tables: vectors and features by path, pair verdicts by a pair of paths.

A row is valid while the modification time it was computed for differs by less than TOLERANCE from the item's. A table is dealt
into buckets by its key; an upsert rewrites the buckets that it touches and publishes a version that takes all others over, so
several writers may work at once. A version's row counts are in its manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.lineage import cut
from kindred.sources.commits import Versions

#: Seconds.
TOLERANCE = 0.01
#: Buckets of a new table: each is rewritten as a whole.
BUCKETS = 64
EMBEDDINGS = "path string, mtime double, embedding array<float>"
FEATURES = "path string, mtime double, keypoints array<struct<angle:float,size:float>>, descriptors array<array<float>>"
VERDICTS = "path1 string, path2 string, mtime1 double, mtime2 double, accepted boolean, angle double, scale double, angle_votes int, scale_votes int"


def fresh(a: Column | str, b: Column | str) -> Column:
    return F.abs((F.col(a) if isinstance(a, str) else a) - (F.col(b) if isinstance(b, str) else b)) < TOLERANCE


class CacheTable:
    """A table with a key at `path`: read, upsert, count, clear. `buckets` holds for a table that is new."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.versions = Versions(spark, path)

    def _parts(self, manifest: dict | None) -> dict[str, dict]:
        return (manifest or {}).get("buckets", {})

    def _of(self, parts: dict[str, dict], names: list[str]) -> DataFrame:
        found = [parts[b]["folder"] for b in names if b in parts]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def size(self) -> int:
        """Number of buckets."""
        return (self.versions.latest()[1] or {}).get("size", self.buckets)

    def read(self) -> DataFrame:
        """The rows of the latest version, whatever is published afterwards."""
        parts = self._parts(self.versions.latest()[1])
        return self._of(parts, list(parts))

    def count(self) -> int:
        return sum(x["rows"] for x in self._parts(self.versions.latest()[1]).values())

    def upsert(self, rows: DataFrame) -> int:
        """Rows of `rows` replace those of equal keys; returns the number of the version published.

        Of rows that repeat a key, that of largest values stays. Null keys are not kept. Where another writer came first,
        only those of the touched buckets that it touched too are merged again.
        """
        size = self.size()
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        columns = [f.name for f in fields]
        rest = [c for c in columns if c not in self.keys]
        known = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).where(" and ".join(f"{k} is not null" for k in self.keys))
        new = known.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("x")).select(*self.keys, *(F.col(f"x.{c}").alias(c) for c in rest))
        new = cut(new.select(*columns, self.bucket(size).alias("bucket")))
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # buckets at most
        merged: dict[str, tuple[str | None, dict]] = {}  # of each touched bucket, the folder it was merged from and what came out

        def change(number: int, base: dict | None) -> dict:
            parts = self._parts(base)
            stale = [b for b in touched if b not in merged or merged[b][0] != parts.get(b, {}).get("folder")]
            try:
                merged.update(self._merge(new, parts, stale, size) if stale else {})
            except Exception:
                if self.versions.latest()[0] == number:
                    raise
                return {}  # another writer removed what was read; its version is taken, so this one isn't published
            return {"size": size, "buckets": parts | {b: merged[b][1] for b in touched}}

        return self.versions.commit(change)[0]

    def _merge(self, new: DataFrame, parts: dict[str, dict], names: list[str], size: int) -> dict[str, tuple[str | None, dict]]:
        fresh_rows = new.where(F.col("bucket").isin([int(b) for b in names]))
        kept = self._of(parts, names).join(fresh_rows.select(*self.keys), list(self.keys), "left_anti")
        path = self.versions.new_data()
        out = kept.withColumn("bucket", self.bucket(size)).select(*new.columns).unionByName(fresh_rows)
        out.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        counts = {str(r.bucket): r.n for r in self.spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {b: (parts.get(b, {}).get("folder"), {"folder": f"{path}/bucket={b}", "rows": counts[b]}) for b in names}

    def clear(self) -> int:
        """Publishes a version without rows and deletes the data of the one before; returns the bytes freed."""
        gone: dict[str, dict] = {}

        def change(number: int, base: dict | None) -> dict:
            gone.clear()
            gone.update(self._parts(base))
            return {"size": self.buckets, "buckets": {}}

        self.versions.commit(change)
        folders = {x["folder"] for x in gone.values()}
        freed = sum(self.versions.size(f) for f in folders)
        for f in folders:
            fs, p = self.versions.folder(f)
            fs.delete(p, True)
        return freed

    def vacuum(self, keep: int = 2, age: float = 86_400.0) -> int:
        """Deletes data that only older versions name, or none; see `Versions.vacuum`."""
        return self.versions.vacuum(lambda m: {x["folder"].rpartition("/")[0] for x in self._parts(m).values()}, keep, age)


def embeddings(spark: SparkSession, path: str, buckets: int = BUCKETS) -> CacheTable:
    return CacheTable(spark, path, EMBEDDINGS, ("path",), buckets)


def features(spark: SparkSession, path: str, buckets: int = BUCKETS) -> CacheTable:
    return CacheTable(spark, path, FEATURES, ("path",), buckets)


def verdicts(spark: SparkSession, path: str, buckets: int = BUCKETS) -> CacheTable:
    return CacheTable(spark, path, VERDICTS, ("path1", "path2"), buckets)


def hits(items: DataFrame, cached: DataFrame) -> DataFrame:
    """`items` (path, mtime, ...) that have a valid row in `cached` (path, mtime, values), with its values."""
    c = cached.withColumnRenamed("mtime", "__then")
    return items.join(c, "path").where(fresh("mtime", "__then")).drop("__then")


def misses(items: DataFrame, cached: DataFrame) -> DataFrame:
    """`items` (path, mtime, ...) without a valid row in `cached`: those to compute."""
    c = cached.select(F.col("path").alias("__path"), F.col("mtime").alias("__then"))
    return items.join(c, (F.col("path") == F.col("__path")) & fresh("mtime", "__then"), "left_anti")


def canonical(pairs: DataFrame) -> DataFrame:
    """(path1, path2, mtime1, mtime2, ...) with the smaller path first; times move along, all other columns stay."""
    swap = F.col("path1") > F.col("path2")
    out = {a: F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in (("path1", "path2"), ("path2", "path1"), ("mtime1", "mtime2"), ("mtime2", "mtime1"))}
    return pairs.select(*(out.get(c, F.col(c)).alias(c) for c in pairs.columns))


def verdict_hits(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """`pairs` (path1, path2, mtime1, mtime2), made canonical, that have a valid verdict, with its values."""
    c = cached.withColumnsRenamed({"mtime1": "__then1", "mtime2": "__then2"})
    return canonical(pairs).join(c, ["path1", "path2"]).where(fresh("mtime1", "__then1") & fresh("mtime2", "__then2")).drop("__then1", "__then2")


def verdict_misses(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """`pairs`, made canonical, without a valid verdict."""
    c = cached.select(*(F.col(x).alias(f"__{x}") for x in ("path1", "path2", "mtime1", "mtime2")))
    same = (F.col("path1") == F.col("__path1")) & (F.col("path2") == F.col("__path2")) & fresh("mtime1", "__mtime1") & fresh("mtime2", "__mtime2")
    return canonical(pairs).join(c, same, "left_anti")
