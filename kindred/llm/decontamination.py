"""Benchmark decontamination by one Aho-Corasick automaton over the word windows of test items.

A window is a run of item words, a short item is one window. The automaton reads a text once, word by word: each word that items
hold is one symbol, all others are one that no window has. Words it hits are mapped to their place in the original text.
Windows of more items than an automaton may hold are dealt to several; a text is then read once by each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import counted, cut, left_join_hot, sliced
from kindred.llm.folded import FOLD, folded_words

#: Pairs of a window and an item that one automaton holds at most, on average, and bytes of their words.
MOST, MOST_BYTES = 100_000, 32 << 20
#: Windows that a task hands on at once.
RUN = 50_000
#: Symbol of words that are in no window.
NONE = "\x01"
HITS = "array<struct<word:int,start:int,stop:int>>"
_HIT = pa.struct([("word", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
#: Java regular expression of a word before letters are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def symbol(i: int) -> str:
    """The i-th character that is no surrogate and not NONE."""
    i += 2
    return chr(i if i < 0xD800 else i + 0x800)


class Windows:
    """Windows and their items; tasks build the automaton from them once a worker."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        self.pairs, self.ready = pairs, False

    def __getstate__(self) -> dict:
        return {"pairs": self.pairs, "ready": False}

    def build(self) -> Windows:
        if not self.ready:
            items: dict[bytes, list[str]] = {}
            for window, item in self.pairs:
                items.setdefault(window, []).extend([item] if item is not None else [])
            self.symbols: dict[bytes, str] = {}
            for w in items:
                for word in w.split(b" "):
                    self.symbols.setdefault(word, symbol(len(self.symbols)))
            self.automaton = ahocorasick.Automaton()
            for k, (w, named) in enumerate(items.items()):
                key = "".join(map(self.symbols.__getitem__, w.split(b" ")))
                self.automaton.add_word(key, (k, len(key), named))
            self.automaton.make_automaton()
            self.ready = True
        return self

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Numbers of the words that are hit, in order, and the items whose windows occur, sorted."""
        get = self.symbols.get
        ends, lengths, seen, items = [], [], set(), set()
        for end, (k, n, named) in self.automaton.iter("".join([get(w, NONE) for w in words])):
            ends.append(end)
            lengths.append(n)
            if k not in seen:
                seen.add(k)
                items.update(named)
        if not ends:
            return np.zeros(0, np.int64), []
        stop = np.array(ends) + 1
        depth = np.bincount(stop - lengths, minlength=len(words) + 1) - np.bincount(stop, minlength=len(words) + 1)
        return np.flatnonzero(np.cumsum(depth)), sorted(items)


def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of every word of a UTF-8 text."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edge = np.diff(inside)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]


def windows_of(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(window binary, item string), without repetition: every run of `n` words of an item, or all its words if they are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = folded_words(text)
                count = max(1, len(words) - n + 1) if words else 0
                for k in range(0, count, RUN):
                    found = [b" ".join(words[i : i + n]) for i in range(k, min(k + RUN, count))]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], names=["window", "item"])

    src = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "window binary, item string").distinct()


def _scanned(rows: DataFrame, sent, kind: str, hits_only: bool) -> DataFrame:
    """(id, n_words, hits, item_ids) of `rows` (id, text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.build() if sent is not None else None
        for batch in sliced(batches, "text"):
            count, items, at, start, stop, size = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = folded_words(text)
                hit, named = w.scan(words) if w and words else (np.zeros(0, np.int64), [])
                count.append(len(words))
                items.append(named)
                size.append(len(hit))
                if len(hit):
                    a, b = places(text)
                    at.append(hit)
                    start.append(a[hit])
                    stop.append(b[hit])
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int32(), safe=False) for x in (at, start, stop)]
            hits = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.StructArray.from_arrays(flat, fields=list(_HIT)))
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), hits, pa.array(items, pa.list_(pa.string()))], names=["id", "n_words", "hits", "item_ids"])
            yield out.filter(pa.array(np.array(size) > 0)) if hits_only else out

    return rows.mapInArrow(run, f"id {kind}, n_words long, hits {HITS}, item_ids array<string>")


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, most: int = MOST) -> DataFrame:
    """(id, n_words, hits, item_ids) of every row: `hits` are the words inside any window's occurrence, by number, with their place in the text in characters.

    Null and empty texts have no words. `item_ids` are the items with a window in the text, as strings in order of their
    bytes, each once; windows of an item without id hit but name nothing. Items without words have no window. Rows that
    repeat an item id are one item with the windows of all; repeated documents are answered each.
    """
    pairs, n = counted(windows_of(items, item_col, item_text_col, window))
    size = pairs.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    shards = max(1, -(-n // most), -(-size // MOST_BYTES))
    sc, kind = docs.sparkSession.sparkContext, docs.select(id_col).schema[0].dataType.simpleString()
    dealt = pairs.withColumn("shard", F.pmod(F.xxhash64("window", "item"), F.lit(shards)))

    def shard(k: int):
        """A shard's windows, broadcast: `most` pairs and MOST_BYTES on average."""
        return sc.broadcast(Windows([(bytes(r.window), r.item) for r in dealt.where(F.col("shard") == k).collect()])) if n else None

    text = F.col(text_col).cast("binary").alias("text")
    if shards == 1:
        out = _scanned(docs.select(F.col(id_col).alias("id"), text), shard(0), kind, False)
        return out.withColumnRenamed("id", id_col)
    # results hang on the text alone, so those of several automata meet by its digest, which only texts with hits have
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("id"), text)
    found = [cut(_scanned(texts, shard(k), "string", True).dropDuplicates(["id"])) for k in range(shards)]
    merged = reduce(DataFrame.unionByName, found).groupBy("id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "item_ids")))
    count = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    base = cut(docs.select(F.col(id_col).alias("own"), count.alias("n_words"), key.alias("id")))
    out = left_join_hot(base, cut(merged), "id")
    return out.select(F.col("own").alias(id_col), "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
