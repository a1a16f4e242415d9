"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: of the word runs that begin inside a window, the one of smallest hash (leftmost if equal). Equal
windows have the same anchor at the same place, so any repeat of a window's length meets at an anchor. Documents are joined
on anchors, and a match is extended both ways: first over the whole stretch of windows that the anchor stands for, if all
its words are equal; where stretches of an anchor differ, by every number of words to the left that leaves a window.
Equality is that of 128-bit BLAKE2b digests of the words themselves. Matches of two documents that lie on one diagonal
(equal distance of places) and overlap or touch are one, up to maximal repeats, over the window's length by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import cut, join_hot, sliced, small_side
from kindred.llm.text_hash import digests, spans, sums, words

#: Words of an anchor.
SEED = 16
#: Ids up to which documents that need extension are picked before their texts are shuffled.
FEW = 200_000


def stretches(h: np.ndarray, bound: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of the texts whose words hash to `h`: text number, anchor hash, first and last window start of each anchor's stretch."""
    starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(bound[:-1], bound[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    n = len(h) - seed + 1
    at = np.arange(n)
    anchor = spans(sums(h), at, at + seed)
    low, place = anchor, at  # smallest of a growing number of neighbours, and where it is
    span, reach = 1, window - seed + 1
    while span < reach:
        step = min(span, reach - span)
        a, b = low[: len(low) - step], low[step:]
        later = b < a
        low, place = np.where(later, b, a), np.where(later, place[step:], place[: len(low) - step])
        span += step
    owner = place[starts]
    text = np.searchsorted(bound, starts, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return text[first], anchor[owner[first]], starts[first], starts[last]


def seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(anchor, context, id, lo, hi): an anchor, the digest of all words of its stretch, and the first and last window start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            h, bound, flat = words([t.encode() for t in batch.column("text").to_pylist()])
            text, anchor, lo, hi = stretches(h, bound, window, seed)
            if len(text):
                context = pa.array(digests(flat, lo, hi + window), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), context, batch.column("id").take(pa.array(text)), pa.array(lo - bound[text]), pa.array(hi - bound[text])], names=["anchor", "context", "id", "lo", "hi"])

    return docs.select("id", "text").where("text is not null and id is not null").mapInArrow(run, "anchor long, context binary, id long, lo long, hi long")


def windows_of(parts: DataFrame, window: int) -> DataFrame:
    """(words binary, id, start) of the windows in the stretches `at array<struct<lo, hi>>` of each (id, text, at), with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            _, bound, flat = words([t.encode() for t in batch.column("text").to_pylist()])
            starts, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, at in enumerate(batch.column("at")):
                lo, hi = (at.values.field(k).to_numpy() for k in (0, 1))
                s = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]))
                s = s[s + window <= bound[i + 1] - bound[i]]
                starts.append(s)
                rows.append(np.full(len(s), i))
            s, r = np.concatenate(starts), np.concatenate(rows)
            for k in range(0, len(s), 1 << 16):
                u, w = s[k : k + (1 << 16)], r[k : k + (1 << 16)]
                g = u + bound[w]
                yield pa.RecordBatch.from_arrays([pa.array(digests(flat, g, g + window), pa.binary()), batch.column("id").take(pa.array(w)), pa.array(u)], names=["words", "id", "start"])

    return parts.select("id", "text", "at").mapInArrow(run, "words binary, id long, start long")


def matches(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(id, lo, hi, first, first_lo): runs of window starts whose windows also start, from `first_lo` on, in the document `first` of smaller id.

    `docs` has (id, text). Every window that also starts in a document of smaller id lies in one of the runs.
    """
    occ = cut(seeds(docs, window, seed))
    # an anchor of one document seeds nothing
    anchors = occ.groupBy("anchor").agg(F.min("id").alias("from"), F.max("id").alias("to"), (F.min("context") != F.max("context")).alias("differ"), F.count(F.lit(1)).alias("n")).where("from < to")
    live = cut(join_hot(occ, cut(anchors.select("anchor", "differ", "n")), ["anchor"]))
    first = live.groupBy("anchor", "context").agg(F.min(F.struct("id", "lo")).alias("f"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    first = cut(first.select("anchor", "context", F.col("f.id").alias("first"), F.col("f.lo").alias("first_lo"), "last", "n"))
    whole = join_hot(live.select("anchor", "context", "id", "lo", "hi"), first.where("first < last").drop("last"), ["anchor", "context"]).where("id > first").select("id", "lo", "hi", "first", "first_lo")
    # one document of each context stands for it where contexts differ
    stands = live.where("differ").groupBy("anchor", "context").agg(F.min(F.struct("id", "lo", "hi")).alias("s"))
    apart = cut(stands.groupBy("s.id").agg(F.collect_set(F.struct("s.lo", "s.hi")).alias("at")))
    some = docs.where("text is not null").join(small_side(apart.select("id"), FEW), "id", "left_semi")
    w = cut(windows_of(some.join(apart, "id"), window))
    least = w.groupBy("words").agg(F.min(F.struct("id", "start")).alias("f"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("f.id < last")
    least = cut(least.select("words", F.col("f.id").alias("first"), F.col("f.start").alias("first_lo"), "n"))
    single = join_hot(w, least, ["words"]).where("id > first").select("id", F.col("start").alias("lo"), F.col("start").alias("hi"), "first", "first_lo")
    return whole.unionByName(single)


def repeats(src: DataFrame, window: int, seed: int) -> DataFrame:
    """(id, start, length, first, first_start): matches on one diagonal that overlap or touch, as one run of words."""
    m = matches(src, window, seed).withColumn("shift", F.col("lo") - F.col("first_lo"))
    order = Window.partitionBy("id", "first", "shift").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)) + window
    marked = m.withColumn("new", F.when(reach >= F.col("lo"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = marked.groupBy("id", "first", "shift", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("stop"))
    return runs.select("id", "start", (F.col("stop") - F.col("start") + window).alias("length"), "first", (F.col("start") - F.col("shift")).alias("first_start"))


def maximal_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = SEED) -> DataFrame:
    """(id, start, length, first, first_start): word runs of `window` words or more that the document `first` of smaller id has too.

    Of several documents that hold a passage, that of smallest id is `first`. Null ids and texts have no repeats.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return repeats(src, window, seed).withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row.

    Words are runs of other than space and ASCII 9 to 13, unchanged. A word goes if a window of `window` words over it also
    starts in a document of smaller id; windows are judged on the input. Null texts have no words, and shorter texts no
    windows. Rows that repeat an id are one document to others and are judged each by that id's windows; with different
    texts under one id, positions found in any of them apply to all. Null ids lose nothing.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = repeats(src, window, seed).groupBy("id").agg(F.collect_set(F.struct("start", "length")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            n_words, n_removed, kept = [], [], []
            for t, at in zip(batch.column("text").to_pylist(), batch.column("at"), strict=True):
                w = (t or "").encode().split()
                n, gone = len(w), 0
                if at.is_valid and n:
                    start, length = (at.values.field(k).to_numpy() for k in (0, 1))
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(start, n), 1)
                    np.add.at(edge, np.minimum(start + length, n), -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    w = [w[i] for i in np.flatnonzero(~covered)]
                n_words.append(n)
                n_removed.append(gone)
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    # null ids have no key to meet on, and would all go to one task
    known = src.where("id is not null").join(gone, "id", "left").select("id", "text", "at")
    rest = src.where("id is null").withColumn("at", F.lit(None).cast("array<struct<start:bigint,length:bigint>>")).select("id", "text", "at")
    out = known.unionByName(rest).mapInArrow(run, "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)
