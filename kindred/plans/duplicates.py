"""The duplicate search: pairs, clusters, pair scoring, verification and grouping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.vectors import dot
from kindred.operators import quantizer
from kindred.operators.cliques import maximal_cliques
from kindred.operators.clusters import average_linkage, constrained_clusters, split_oversize
from kindred.operators.lineage import cut
from kindred.operators.numbering import numbered
from kindred.operators.pairs import pairs_within, sound
from kindred.operators.votes import verify_pairs
from kindred.sources import cache, fitted
from kindred.sources.results import pair_struct

VERDICT = ("accepted", "angle", "scale", "angle_votes", "scale_votes")


@dataclass(frozen=True)
class Settings:
    distance_threshold: float = 0.45
    transitivity_ratio: float = 0.7
    max_cluster_size: int = 50
    min_similarity: float = 0.5
    #: Share of the good matches that the fullest bins of a geometric vote hold.
    vote_threshold: float = 0.3
    parts: int = quantizer.PARTS
    centroids: int = quantizer.SIZE
    neighbours: int = quantizer.NEIGHBOURS
    #: "linkage" (also None): average linkage. "constrained": size-constrained merging of all close pairs. "quantized": of the
    #: nearest items by quantized vectors. The number of items never chooses.
    mode: str | None = "linkage"
    #: Folder that keeps the codebook and neighbours of the quantized mode for the next search of the same vectors; none if None.
    fitted_path: str | None = None


def cluster(items: DataFrame, s: Settings, edges: DataFrame | None = None) -> DataFrame:
    """(item_id, label) of all items with a usable vector; members of clusters over the largest size stand alone.

    `edges` are the items' `pairs_within` under the threshold, if they are at hand; the quantized mode takes none.
    """
    v, mode = cut(sound(items).withColumnRenamed("v", "embedding")), s.mode or "linkage"
    if mode == "quantized":
        dim = v.agg(F.max(F.size("embedding"))).first()[0] or s.parts
        pairs = fitted_pairs(v, s, dim) if s.fitted_path else quantizer.neighbour_pairs(v, quantizer.train(v, s.parts, s.centroids, dim), s.distance_threshold, s.neighbours)
        labels = quantizer.clusters_of(v, quantizer.exact_distances(v, cut(pairs)), s.distance_threshold, s.transitivity_ratio)
    else:
        edges = pairs_within(v, s.distance_threshold) if edges is None else edges
        if mode == "linkage":
            labels = average_linkage(v, edges, s.distance_threshold)
        else:
            labels = constrained_clusters(v, edges, s.distance_threshold, s.transitivity_ratio)
    return cut(split_oversize(labels, s.max_cluster_size))


def fitted_pairs(v: DataFrame, s: Settings, dim: int) -> DataFrame:
    """Neighbour pairs by codes; codebook and pairs are taken from `fitted_path` if kept for these vectors and parameters, else kept there."""
    spark, shape = v.sparkSession, {"parts": s.parts, "centroids": s.centroids}
    book_mark = fitted.fingerprint(v, **shape)
    mark = fitted.fingerprint(v, **shape, threshold=s.distance_threshold, neighbours=s.neighbours)
    found = fitted.load_neighbours(spark, f"{s.fitted_path}/neighbours", mark)
    if found is not None:
        return found
    book = fitted.load_codebook(spark, f"{s.fitted_path}/codebook", book_mark)
    if book is None:
        book = quantizer.train(v, s.parts, s.centroids, dim)
        fitted.save_codebook(book, f"{s.fitted_path}/codebook", book_mark)
    pairs = cut(quantizer.neighbour_pairs(v, book, s.distance_threshold, s.neighbours))
    fitted.save_neighbours(pairs, f"{s.fitted_path}/neighbours", mark)
    return pairs


def cluster_pairs(items: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, i, j, similarity) of all pairs inside a cluster, i < j; clusters are bounded, so pairs are too."""
    v = sound(items).join(labels, "item_id")
    a, b = v.toDF("i", "va", "label"), v.toDF("j", "vb", "label")
    return a.join(b, "label").where("i < j").select("label", "i", "j", dot("va", "vb").alias("similarity"))


def cached_verdicts(pairs: DataFrame, items: DataFrame, features: DataFrame, store: cache.CacheTable, threshold: float, **limits) -> DataFrame:
    """(i, j, verdict columns) of `pairs` (i, j, perhaps the `label` of their cluster): valid ones from `store`, the rest computed from `features` and added to it.

    `items` has (item_id, path, mtime). The vote goes from the smaller path to the larger one.
    """
    at = items.select("item_id", "path", "mtime")
    named = pairs.select("i", "j", *(["label"] if "label" in pairs.columns else [])).join(at.toDF("i", "path1", "mtime1"), "i").join(at.toDF("j", "path2", "mtime2"), "j")
    swap = F.col("path1") > F.col("path2")
    asked = cut(cache.canonical(named.withColumns({"i": F.when(swap, F.col("j")).otherwise(F.col("i")), "j": F.when(swap, F.col("i")).otherwise(F.col("j"))})))
    old = store.read()
    said = cut(cache.verdict_hits(asked, old).select("i", "j", *VERDICT))
    todo = cut(cache.verdict_misses(asked, old))
    if not todo.isEmpty():
        new = cut(todo.join(verify_pairs(features, todo, threshold, **limits), ["i", "j"]))
        store.upsert(new.select("path1", "path2", "mtime1", "mtime2", *VERDICT))
        said = said.unionByName(new.select("i", "j", *VERDICT))
    return said.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *VERDICT)


def group_pairs(items: DataFrame, settings: Settings = Settings(), verdicts: DataFrame | None = None, features: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(group_id, label, i, j, similarity, accepted, angle, scale, angle_votes, scale_votes): the pairs of every group.

    Without `verdicts` and `features` a group is a cluster, its id the label. Else groups are the maximal cliques of the pairs
    that are accepted, by `verdicts` (i, j, accepted and perhaps the other columns) or a vote over `features`, and similar
    enough; they are numbered from 0 by label and members, and an item may be in several. `pairs` are the `cluster_pairs` of
    the items, if they are at hand.
    """
    pairs = cluster_pairs(items, cluster(items, settings)) if pairs is None else pairs
    zero = {"accepted": F.lit(False), "angle": F.lit(0.0), "scale": F.lit(0.0), "angle_votes": F.lit(0), "scale_votes": F.lit(0)}
    if verdicts is None and features is None:
        return pairs.select(F.col("label").alias("group_id"), "label", "i", "j", "similarity", *(v.alias(k) for k, v in zero.items()))
    pairs = cut(pairs.where(F.col("similarity") >= settings.min_similarity))
    if verdicts is None:
        verdicts = verify_pairs(features, pairs, settings.vote_threshold)
    said = verdicts.where("accepted").select("i", "j", *((F.col(k) if k in verdicts.columns else v).alias(k) for k, v in zero.items())).dropDuplicates(["i", "j"])
    good = cut(pairs.join(said, ["i", "j"]))
    cliques = numbered(cut(maximal_cliques(good)), ["label", "members"], "group_id")
    one = cut(cliques.select("group_id", "label", F.explode("members").alias("m")))
    inside = good.join(one.withColumnRenamed("m", "i"), ["label", "i"]).join(one.withColumnRenamed("m", "j"), ["label", "group_id", "j"])
    return inside.select("group_id", "label", "i", "j", "similarity", *VERDICT)


def find_duplicates(items: DataFrame, settings: Settings = Settings(), verdicts: DataFrame | None = None, features: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(group_id, label, members, n_members, n_pairs, avg_similarity): one row a group of `group_pairs`."""
    pairs = group_pairs(items, settings, verdicts, features, pairs)
    members = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("i", "j")))))
    groups = pairs.groupBy("group_id", "label").agg(members.alias("members"), F.count(F.lit(1)).alias("n_pairs"), F.avg("similarity").alias("avg_similarity"))
    return groups.select("group_id", "label", "members", F.size("members").alias("n_members"), "n_pairs", F.round("avg_similarity", 6).alias("avg_similarity"))


def documents(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(group_id, pairs array<struct>) of `group_pairs`, with the paths of `items` (item_id, path), as result documents hold them."""
    at = items.select("item_id", "path")
    named = pairs.join(at.toDF("i", "path1"), "i").join(at.toDF("j", "path2"), "j")
    return named.groupBy("group_id").agg(F.array_sort(F.collect_list(pair_struct())).alias("pairs"))
