"""Listing of item files with their modification times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of image files, in lower case.
IMAGES = (".jpg", ".jpeg", ".png", ".webp")


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def extension(path: Column | str) -> Column:
    """The extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.[^.]*$", 0))


def any_case(ext: str) -> str:
    """A glob that matches an extension in any case of letters."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def list_files(spark: SparkSession, folder: str, recursive: bool = False, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, name, extension, mtime): files of `folder` with one of `extensions` in any case; subfolders only if `recursive`.

    mtime is in seconds, 0.0 where the file system has none. Contents are not read. A folder without such files is empty.
    """
    glob = "{" + ",".join(any_case(x) for x in extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    mtime = F.coalesce(F.unix_micros("modificationTime") / 1e6, F.lit(0.0)).alias("mtime")
    return files.select("path", file_name("path").alias("name"), extension("path").alias("extension"), mtime)
