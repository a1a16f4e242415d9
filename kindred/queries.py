"""Registered queries of the vector search. Their DuckDB SQL is in kindred.oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.vectors import cosine_distance, normalized
from kindred.operators import clusters, pixels, quantizer, votes
from kindred.operators.components import components
from kindred.operators.lineage import cut, new_path
from kindred.operators.pairs import pairs_within, top_k
from kindred.oracles import ORACLES
from kindred.plans import extraction
from kindred.plans.duplicates import Settings, cached_verdicts, cluster, cluster_pairs, documents, find_duplicates, group_pairs
from kindred.sources import cache, files, fitted, results

__all__ = ["ORACLES", "QUERIES", "flagship"]

#: The synthetic vectors hold almost no pair under the default threshold.
THRESHOLD = 0.6
SEARCH = Settings(distance_threshold=THRESHOLD, mode="constrained", min_similarity=0.35)
#: Shape of the quantizer for vectors of 64 components.
DIM, PARTS, SIZE = 64, 8, 16
#: Limits of the vote for the small feature sets made from vectors.
LIMITS = {"threshold": 0.2, "min_matches": 2, "min_votes": 1}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")


def with_paths(v: DataFrame) -> DataFrame:
    """Items with a made path and time."""
    return v.withColumns({"path": F.concat(F.lit("item-"), F.col("item_id").cast("string")), "mtime": F.col("item_id").cast("double")})


def features(v: DataFrame) -> DataFrame:
    """Keypoints and descriptors made from vectors: 16 descriptors of 4 components; angle and size from the first two."""
    at = F.sequence(F.lit(0), F.lit(15))
    points = F.transform(at, lambda k: F.struct((F.element_at("embedding", k * 4 + 1).cast("double") * 720).alias("angle"), (F.element_at("embedding", k * 4 + 2).cast("double") * 8).alias("size")))
    return v.select("item_id", points.alias("keypoints"), F.transform(at, lambda k: F.slice("embedding", k * 4 + 1, F.lit(4))).alias("descriptors"))


def joined(members: Column | str) -> Column:
    return F.array_join(F.transform(members, lambda x: x.cast("string")), ",")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_duplicates(items(spark, sf_dir), SEARCH).withColumn("members", joined("members"))


def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(items(spark, sf_dir), THRESHOLD).select("i", "j", F.round("dist", 6).alias("dist"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir)
    return top_k(v, v, 5).select("query_id", "item_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


def next_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each item's vector, scaled and normalised again, to that of the item after it."""
    v = items(spark, sf_dir)
    scaled = v.select("item_id", normalized(F.transform("embedding", lambda x: x.cast("double") * (F.col("item_id") % 7 + 1))).alias("u"))
    after = v.select((F.col("item_id") - 1).alias("item_id"), normalized("embedding").alias("w"))
    return scaled.join(after, "item_id").select("item_id", F.round(cosine_distance("u", "w"), 6).alias("dist"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(pairs_within(items(spark, sf_dir), THRESHOLD))


def constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(items(spark, sf_dir), Settings(distance_threshold=THRESHOLD, mode="constrained"))


def linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(items(spark, sf_dir), Settings(distance_threshold=THRESHOLD, mode="linkage"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_sizes(linked(spark, sf_dir))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.split_oversize(linked(spark, sf_dir), 3)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_totals(linked(spark, sf_dir))


def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.largest_clusters(linked(spark, sf_dir), over=2)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dense_labels(linked(spark, sf_dir))


def cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir)
    verdicts = pairs_within(v, THRESHOLD).select("i", "j", F.lit(True).alias("accepted"))
    return find_duplicates(v, SEARCH, verdicts).withColumn("members", joined("members"))


def codebook(v: DataFrame) -> DataFrame:
    return quantizer.first_rows_codebook(v, PARTS, SIZE, DIM)


def components_of(v: DataFrame, *ids: str, array: str) -> DataFrame:
    return v.select(*ids, F.posexplode(array).alias("pos", "value")).withColumn("value", F.round("value", 6))


def pq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of k-means from the first rows."""
    v = items(spark, sf_dir)
    book = quantizer.train(v, PARTS, SIZE, DIM, iterations=2, start=codebook(v))
    return components_of(book, "m", "k", array="centroid")


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir)
    return quantizer.encode(v, codebook(v)).select("item_id", F.posexplode("codes").alias("m", "k"))


def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir)
    book = codebook(v)
    return components_of(quantizer.decode(quantizer.encode(v, book), book), "item_id", array="embedding")


def adc_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table distance of each item to the code of the item after it."""
    v = items(spark, sf_dir)
    book = codebook(v)
    after = quantizer.encode(v, book).withColumn("item_id", F.col("item_id") - 1)
    both = quantizer.lookup_tables(v, book).join(after, "item_id")
    return both.select("item_id", F.round(quantizer.table_distance("table", "codes"), 6).alias("dist"))


def adc_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir)
    book = codebook(v)
    out = quantizer.adc_top_k(v, quantizer.encode(v, book), book, quantizer.NEIGHBOURS + 1)
    return out.select("query_id", "item_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


def pq_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir)
    return quantizer.quantized_clusters(v, THRESHOLD, parts=PARTS, size=SIZE, dim=DIM, codebook=codebook(v))


def ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir)
    out = votes.ratio_matches(features(v), pairs_within(v, THRESHOLD))
    return out.withColumn("dist", F.round("dist", 6))


def geometric_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir)
    out = votes.verify_pairs(features(v), cut(pairs_within(v, THRESHOLD).select("i", "j")), **LIMITS)
    return out.withColumns({"angle": F.round("angle", 6), "scale": F.round("scale", 6)})


def verified_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the search with verdicts of the vote on near pairs; the second search takes all verdicts from the cache.

    Groups lie inside clusters, so the vote is on the pairs there, whose number grows with the items, and not on all near pairs.
    """
    v = with_paths(items(spark, sf_dir))
    pairs = cut(cluster_pairs(v, cluster(v, SEARCH)))
    near = cut(pairs.where(F.lit(1.0) - F.col("similarity") < THRESHOLD).select("i", "j", "label"))
    store = cache.verdicts(spark, new_path(spark, "verdicts"))
    cached_verdicts(near, v, features(v), store, **LIMITS)
    again = cached_verdicts(near, v, features(v).limit(0), store, **LIMITS)
    return find_duplicates(v, SEARCH, cut(again), pairs=pairs).withColumn("members", joined("members"))


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by whether their cached vector is valid, after an upsert of others: every third is cached, every sixth too old."""
    v = with_paths(items(spark, sf_dir))
    store = cache.embeddings(spark, new_path(spark, "embeddings"))
    rows = v.where("item_id % 3 = 0").select("path", (F.col("mtime") - (F.col("item_id") % 2) * 0.02).alias("mtime"), "embedding")
    store.upsert(rows.withColumn("mtime", F.col("mtime") - 1))
    store.upsert(rows)
    here = v.select("path", "mtime")
    hit, miss = cache.hits(here, store.read()), cache.misses(here, store.read())
    first = F.round(F.element_at("embedding", 1).cast("double"), 6)
    return hit.select("path", F.lit(True).alias("cached"), first.alias("first")).unionByName(miss.select("path", F.lit(False).alias("cached"), F.lit(None).cast("double").alias("first")))


def codebook_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook saved with the fingerprint of its vectors and parameters and loaded again; another fingerprint finds none."""
    v, path = items(spark, sf_dir), new_path(spark, "codebook")
    mark = fitted.fingerprint(v, parts=PARTS, size=SIZE)
    fitted.save_codebook(codebook(v), path, mark)
    if fitted.load_codebook(spark, path, fitted.fingerprint(v, parts=PARTS, size=SIZE + 1)) is not None:
        raise ValueError("a codebook of other parameters was taken")
    return components_of(fitted.load_codebook(spark, path, mark), "m", "k", array="centroid")


def neighbour_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour edges by codes, saved and loaded by fingerprint."""
    v, path = items(spark, sf_dir), new_path(spark, "neighbours")
    mark = fitted.fingerprint(v, parts=PARTS, size=SIZE, threshold=THRESHOLD, neighbours=quantizer.NEIGHBOURS)
    fitted.save_neighbours(quantizer.neighbour_pairs(v, codebook(v), THRESHOLD), path, mark)
    return fitted.load_neighbours(spark, path, mark)


def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the search written as a result document, read back and summed up."""
    v, path = with_paths(items(spark, sf_dir)), new_path(spark, "result")
    results.save_result(documents(group_pairs(v, SEARCH), v), path, sf_dir, "2024-01-01 00:00:00")
    out = results.group_summary(results.load_result(spark, path))
    return out.select("group_id", F.array_join("paths", ",").alias("paths"), "members", "verified", F.round("avg_similarity", 6).alias("avg_similarity"))


def search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all items by every mode, whatever their number; one centroid a part."""
    v, out = items(spark, sf_dir), None
    edges = cut(pairs_within(v, THRESHOLD))
    for mode in ("linkage", "constrained", "quantized"):
        labels = cluster(v, Settings(distance_threshold=THRESHOLD, mode=mode, parts=PARTS, centroids=1), edges).select(F.lit(mode).alias("mode"), "item_id", "label")
        out = labels if out is None else out.unionByName(labels)
    return out


def random_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(quantizer.random_codebook(items(spark, sf_dir), PARTS, SIZE, DIM), "m", "k", array="centroid")


def vote_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote's own limits, over items and copies that keep all of 64 descriptors, 50, 49 or 9."""
    v = items(spark, sf_dir)
    kept = F.when(F.col("item_id") % 4 == 0, 64).when(F.col("item_id") % 4 == 1, 50).when(F.col("item_id") % 4 == 2, 49).otherwise(9)

    def of(copy: bool) -> DataFrame:
        angle, size = (lambda k: k * 5.0 - 40, lambda k: (k % 4 + 1) / 2) if copy else (lambda k: k * 5.0, lambda k: k % 4 + 1.0)

        def descriptor(k: Column) -> Column:
            own = F.array(*(F.element_at("embedding", (k + d) % 64 + 1).cast("double") for d in (0, 1, 5, 17)))
            return F.when(k < kept, own).otherwise(F.array(k * 100.0, F.lit(3.0), F.lit(5.0), F.lit(7.0))) if copy else own

        at = F.sequence(F.lit(0), F.lit(63))
        points = F.transform(at, lambda k: F.struct(angle(k).alias("angle"), size(k).alias("size")))
        return v.select((F.col("item_id") + 1_000_000 if copy else F.col("item_id")).alias("item_id"), points.alias("keypoints"), F.transform(at, descriptor).alias("descriptors"))

    pairs = v.select(F.col("item_id").alias("i"), (F.col("item_id") + 1_000_000).alias("j"))
    out = votes.verify_pairs(cut(of(False).unionByName(of(True))), cut(pairs), 0.3)
    return out.withColumns({"angle": F.round("angle", 6), "scale": F.round("scale", 6)})


def verified_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of accepted pairs as a result document, read back and summed up."""
    v, path = with_paths(items(spark, sf_dir)), new_path(spark, "verified")
    verdicts = pairs_within(v, THRESHOLD).select("i", "j", F.lit(True).alias("accepted"))
    results.save_result(documents(group_pairs(v, SEARCH, verdicts), v), path, sf_dir, "2024-01-01 00:00:00")
    out = results.group_summary(results.load_result(spark, path))
    return out.select("group_id", F.array_join("paths", ",").alias("paths"), "members", "verified", F.round("avg_similarity", 6).alias("avg_similarity"))


def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as cached, every fifth replaced by newer ones; the table's count is that of its rows, and none once it is cleared."""
    v = with_paths(items(spark, sf_dir))
    rows = features(v).join(v.select("item_id", "path", "mtime"), "item_id").select("path", "mtime", "keypoints", "descriptors")
    store = cache.features(spark, new_path(spark, "features"), buckets=8)
    store.upsert(rows)
    newer = rows.where(F.col("mtime") % 5 == 0)
    store.upsert(newer.withColumns({"mtime": F.col("mtime") + 1, "keypoints": F.slice("keypoints", 1, 2), "descriptors": F.slice("descriptors", 1, 2)}))
    out = cut(store.read().select("path", "mtime", F.size("keypoints").alias("points"), F.round(F.col("keypoints")[0]["angle"].cast("double"), 4).alias("angle")))
    if store.count() != out.count() or not store.clear() or store.count():
        raise ValueError("the cache counts wrongly")
    return out


class Folded:
    """An embedder that adds up every four numbers, weighted 1 to 4."""

    name, dim = "folded", 16

    def load(self) -> np.ndarray:
        return np.kron(np.eye(16), np.arange(1.0, 5.0)).T

    def prepare(self, content: list[float]) -> np.ndarray:
        return np.array(content, np.float64)

    def embed(self, model: np.ndarray, batch: np.ndarray) -> np.ndarray:
        return batch @ model


def extract_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all items: every sixth is valid in the cache, as many are outdated there, the others are computed; every tenth has no content."""
    v = with_paths(items(spark, sf_dir))
    store = cache.embeddings(spark, new_path(spark, "extracted"), buckets=8)
    old = v.where("item_id % 3 = 0").select("path", (F.col("mtime") - (F.col("item_id") % 2) * 0.02).alias("mtime"), F.array_repeat(F.lit(0.5).cast("float"), 16).alias("embedding"))
    store.upsert(old)
    content = v.select("path", "mtime", F.when(F.col("item_id") % 10 != 1, F.col("embedding")).alias("content"))
    out = extraction.extract_cached(content, Folded(), store, piece=400)
    ends = {name: F.round(F.element_at("embedding", k).cast("double"), 6).alias(name) for name, k in (("first", 1), ("last", 16))}
    return out.select("path", "cached", "failure", *ends.values())


def pixel_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of 4 x 4 pixels made from vectors, stretched to 8 x 2."""
    level = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255))
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 48), lambda x: F.lpad(F.hex(level(x)), 2, "0")), ""))
    images = items(spark, sf_dir).select("item_id", F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(3).alias("channels"), data.alias("data"))
    out = pixels.scale_pixels(images, (8, 2))
    return out.select("item_id", F.posexplode("pixels").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' files; extensions in any case."""
    return files.list_files(spark, sf_dir, extensions=(".PARQUET",)).select("name", "extension", (F.col("mtime") > 0).alias("dated"))


QUERIES = {
    "find_duplicates": flagship,
    "pairs_within": within,
    "top_k": nearest,
    "next_distance": next_distance,
    "components": linked,
    "constrained_clusters": constrained,
    "average_linkage": linkage,
    "cluster_sizes": sizes,
    "split_oversize": split,
    "cluster_totals": totals,
    "largest_clusters": largest,
    "dense_labels": dense,
    "clique_groups": cliques,
    "pq_train": pq_train,
    "pq_encode": pq_encode,
    "pq_decode": pq_decode,
    "adc_distance": adc_distance,
    "adc_top_k": adc_top_k,
    "pq_clusters": pq_clusters,
    "ratio_matches": ratio_matches,
    "geometric_vote": geometric_vote,
    "verified_groups": verified_groups,
    "embedding_cache": embedding_cache,
    "codebook_store": codebook_store,
    "neighbour_store": neighbour_store,
    "result_document": result_document,
    "search_modes": search_modes,
    "random_codebook": random_codebook,
    "vote_limits": vote_limits,
    "verified_document": verified_document,
    "feature_cache": feature_cache,
    "extract_embeddings": extract_embeddings,
    "pixel_scaling": pixel_scaling,
    "list_files": list_files,
}
