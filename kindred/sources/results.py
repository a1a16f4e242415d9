"""Result documents: the groups of a search as nested JSON, one document a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PAIR = "Path1:string,Path2:string,Similarity:double,GeometricVerified:boolean,GeometricAngle:double,GeometricAngleVotes:int,GeometricScale:double,GeometricScaleVotes:int"
GROUP = f"ClusterId:bigint,Pairs:array<struct<{PAIR}>>"
#: A line is one group with its search: a document per group, so that no task holds a whole search.
SCHEMA = f"DirectoryPath string, SavedAt timestamp, Group struct<{GROUP}>, _corrupt string"


def save_result(groups: DataFrame, path: str, folder: str, saved_at: str) -> None:
    """Writes groups (group_id, pairs array<struct> of `pair_struct`) as JSON lines at `path`, replacing what is there."""
    group = F.struct(F.col("group_id").cast("long").alias("ClusterId"), F.col("pairs").alias("Pairs"))
    groups.select(F.lit(folder).alias("DirectoryPath"), F.lit(saved_at).cast("timestamp").alias("SavedAt"), group.alias("Group")).write.mode("overwrite").json(path)


def load_result(spark: SparkSession, path: str) -> DataFrame | None:
    """(directory, saved_at, group_id, pairs) of a saved result; None if nothing is there or a line is malformed."""
    try:
        found = spark.read.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
        if not found.where("_corrupt is not null or Group is null").isEmpty():
            return None
    except AnalysisException:  # nothing there
        return None
    return found.select(F.col("DirectoryPath").alias("directory"), F.col("SavedAt").alias("saved_at"), F.col("Group.ClusterId").alias("group_id"), F.col("Group.Pairs").alias("pairs"))


def pair_struct() -> Column:
    """A pair of (path1, path2, similarity, accepted, angle, scale, angle_votes, scale_votes) as a struct of the document's fields."""
    names = {"path1": "Path1", "path2": "Path2", "similarity": "Similarity", "accepted": "GeometricVerified", "angle": "GeometricAngle", "angle_votes": "GeometricAngleVotes", "scale": "GeometricScale", "scale_votes": "GeometricScaleVotes"}
    return F.struct(*(F.col(a).alias(b) for a, b in names.items()))


def group_summary(groups: DataFrame) -> DataFrame:
    """(group_id, paths, members, verified, avg_similarity) of groups (group_id, pairs); a group without pairs has 0."""
    paths = F.array_sort(F.array_distinct(F.concat(F.transform("pairs", lambda p: p["Path1"]), F.transform("pairs", lambda p: p["Path2"]))))
    total = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["Similarity"])
    avg = F.when(F.size("pairs") > 0, total / F.size("pairs")).otherwise(0.0)
    return groups.select("group_id", paths.alias("paths"), F.size(paths).alias("members"), F.exists("pairs", lambda p: p["GeometricVerified"]).alias("verified"), avg.alias("avg_similarity"))
