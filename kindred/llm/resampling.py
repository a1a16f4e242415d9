"""Resampling towards a target distribution by importance weights of hashed n-grams.

Each run of texts in a partition gets a suffix array over word ids, sorted to the depth of the longest n-gram. Where neighbours
of it have a common prefix of L words or more, their n-grams of L words are one; each such run is hashed once, and its bucket
goes back to all places where it occurs. Counts of the buckets in source and target give every bucket a gain, and a document
the sum of the gains of its n-grams. Gumbel noise from a seeded hash of the id makes the largest scores a weighted draw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import cut, sliced
from kindred.llm.folded import folded_words
from kindred.operators.numbering import numbered

#: Buckets at most: their gains are sent to every task.
MOST_BUCKETS = 1 << 20


def suffix_order(ids: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the words from there on, compared up to `depth` words; a text that ends comes first. `room`: words left in the text."""
    rank, k = ids, 1
    while k < depth:
        after = np.where(room > k, rank[np.minimum(np.arange(len(ids)) + k, len(ids) - 1)] + 1, 0)
        order = np.lexsort((after, rank))
        fresh = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(fresh)])
        k *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, room: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that each position of `order` has in common with the one before, up to `depth`; 0 for the first."""
    out, a, b = np.zeros(len(order), np.int64), order[1:], order[:-1]
    same = np.ones(len(a), bool)
    for k in range(depth):
        last = len(ids) - 1
        same &= (room[a] > k) & (room[b] > k) & (ids[np.minimum(a + k, last)] == ids[np.minimum(b + k, last)])
        out[1:] += same
    return out


def bucket_ids(texts: list[list[bytes]], n: int, buckets: int) -> list[np.ndarray]:
    """For each text (its words) the buckets of all its runs of 1 to `n` words, shorter runs first."""
    flat = [w for t in texts for w in t]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    if not flat:
        return [np.zeros(0, np.int64) for _ in texts]
    number = dict(zip(dict.fromkeys(flat), count()))
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(flat))
    order = suffix_order(ids, room, n)
    common = common_prefixes(ids, room, order, n)
    at = np.empty((n, len(flat)), np.int64)
    for length in range(1, n + 1):
        long = room[order] >= length
        places, first = order[long], (common < length)[long]
        starts = places[first].tolist()
        hashed = np.fromiter((crc32(flat[p] if length == 1 else b" ".join(flat[p : p + length])) for p in starts), np.int64, len(starts)) % buckets
        at[length - 1, places] = hashed[np.cumsum(first) - 1]
    return [np.concatenate([at[k, a : max(a, b - k)] for k in range(n)]) for a, b in zip(ends - np.diff(ends, prepend=0), ends, strict=True)]


def described(docs: DataFrame, id_col: str, text_col: str, n: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets binary) of every row."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = [folded_words(t) for t in batch.column("text").to_pylist()]
            found = bucket_ids(texts, n, buckets)
            size = [pa.array([len(x) for x in y], pa.int64()) for y in (texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *size, pa.array([x.astype(kind).tobytes() for x in found], pa.binary())], names=["id", "n_words", "n_features", "buckets"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "id long, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket comes in `rows` (of `described`)."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in sliced(batches, "buckets"):
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=buckets)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(partial, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.b] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of every bucket."""
    k, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank), all long, of every row: `rank` numbers from 1 those drawn, highest score first, ties to smaller ids.

    Features are all runs of 1 to `n` words, repeats counted. Drawn are floor(percent * N / 100) of the N rows with
    `min_words` words or more. Null and empty texts have no features and weight 0. Rows without id have a weight, but no score,
    and are neither counted in N nor drawn. Repeated rows are answered, counted and drawn each.
    """
    if not 0 < buckets <= MOST_BUCKETS or n < 1:
        raise ValueError("buckets or n out of range")
    rows = cut(described(docs, id_col, text_col, n, buckets))
    wanted = described(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text")), "id", "text", n, buckets)
    sent = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets)))
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "buckets"):
            sums = [int(sent.value[np.frombuffer(x.as_buffer(), kind)].sum()) for x in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    weighed = rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise))
    drawable = F.coalesce((F.col("n_words") >= min_words) & F.col("id").isNotNull(), F.lit(False))
    many = percent * scored.where(drawable).count() // 100
    # equal rows are told apart by their place in the table, as they may be many
    ordered = scored.where(drawable).withColumns({"least": -F.col("score"), "tie": F.monotonically_increasing_id()})
    ranked = numbered(ordered, ["least", "id", "n_features", "weight", "tie"], "rank").withColumn("rank", F.when(F.col("rank") < many, F.col("rank") + 1))
    out = ranked.select("id", "n_features", "weight", "score", "rank").unionByName(scored.where(~drawable).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
    return out.withColumnRenamed("id", id_col)
