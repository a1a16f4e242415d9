"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary, which gives the id of a pre-token that is itself a token. A miss
goes to tier two: the bytes form a doubly linked list, and a heap of adjacent pairs hands out the merge of lowest rank,
leftmost first, until no pair is in the vocabulary.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import sliced, unused

#: Bytes that a worker's memo of encoded words may take (with ENTRY for each); those of tokens and first words take less.
MEMO_BYTES, ENTRY = 320 << 20, 190
#: Where a single space stands between two non-blank characters, every pre-token pattern used here starts a new match at the space.
GAP = re.compile(r"(?<=\S) (?=\S)")
AWKWARD = re.compile(r"\s | \s|\A | \Z")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PerfectHash:
    """Minimal perfect hash of distinct byte strings onto 0 .. n-1 by hash and displace.

    Keys are put into about n/3 buckets; from the largest bucket down, a displacement is sought that sends all of its keys
    to free slots. Buckets of one key take the free slots that are left, their displacement holding -slot-1.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            b, h, step = self._parts(key)
            groups.setdefault(b, []).append((h, step, i))
        self.shift, self.slot_of, taken = [0] * self.buckets, [0] * self.n, bytearray(self.n)
        by_size = sorted(groups.items(), key=lambda x: (-len(x[1]), x[0]))
        for b, members in by_size:
            if len(members) == 1:
                continue
            d = 0
            while True:
                slots = {self._place(h, step, d) for h, step, _ in members}
                if len(slots) == len(members) and not any(taken[s] for s in slots):
                    break
                d += 1
                if d > 100 * self.n + 1000:
                    raise ValueError("no displacement found; keys are not distinct")
            self.shift[b] = d
            for h, step, i in members:
                s = self._place(h, step, d)
                taken[s], self.slot_of[i] = 1, s
        free = (s for s in range(self.n) if not taken[s])
        for b, members in by_size:
            if len(members) == 1:
                s = next(free)
                self.shift[b], self.slot_of[members[0][2]] = -s - 1, s

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        x = xxhash.xxh3_128_intdigest(key)
        return (x & 0xFFFFFFFF) % self.buckets, (x >> 32) & 0xFFFFFFFF, ((x >> 64) & 0xFFFFFFFF) | 1

    def _place(self, h: int, step: int, d: int) -> int:
        x = (h + d * step) & 0xFFFFFFFFFFFFFFFF
        return (((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key; for other strings, some slot (compare the key kept there)."""
        b, h, step = self._parts(key)
        d = self.shift[b]
        return -d - 1 if d < 0 else self._place(h, step, d)


class Memo(dict):
    """Encoded strings, computed once each while remembered, in two generations.

    When the young one reaches its bound of bytes, it becomes the old one, and what that held and was not asked for again is
    forgotten; so frequent words stay. Strings that would fill a large part of it are not remembered.
    """

    def __init__(self, compute: Callable[[str], bytes], bound: int):
        super().__init__()
        self.compute, self.bound, self.held, self.old = compute, bound // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        size = len(key) + len(value) + ENTRY
        if size < self.bound >> 5:
            if self.held + size > self.bound:
                self.old, self.held = self.copy(), 0
                self.clear()
            self[key] = value
            self.held += size
        return value


class Table:
    """A rank file as the encoder needs it: the perfect hash, and the token and id of every slot. Built on the driver, sent to tasks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, keys = ranks, list(ranks)
        self.hash = PerfectHash(keys)
        self.keys, self.ids = [b""] * len(keys), [0] * len(keys)
        for i, key in enumerate(keys):
            s = self.hash.slot_of[i]
            self.keys[s], self.ids[s] = key, ranks[key]
        #: Ranks of pairs of bytes, -1 if they have none.
        self.pairs = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]


class Pool:
    """The bytes of every id, for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        known = np.zeros(len(by_id), bool)
        for key, i in ranks.items():
            by_id[i], known[i] = key, True
        self.bytes, self.known = np.frombuffer(b"".join(by_id), np.uint8), known
        self.length = np.array([len(x) for x in by_id], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if by_id else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids; an id outside the vocabulary raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or not self.known[ids].all()):
            raise ValueError("id outside the vocabulary")
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.start[ids] - (ends - n), n) + np.arange(total)]


class Encoder:
    """Encodes texts by a table; `pattern` splits them into pre-tokens. Texts are parted at gaps only if `gaps` says the pattern allows it."""

    def __init__(self, table: Table, pattern: str, gaps: bool, memo_bytes: int = MEMO_BYTES):
        self.table, self.ranks, self.pattern, self.gaps = table, table.ranks, regex.compile(pattern), gaps
        self.tokens, self.first, self.later = Memo(self._token, memo_bytes // 2), Memo(self._unit, memo_bytes // 8), Memo(self._after_blank, memo_bytes)

    def whole(self, piece: bytes) -> int | None:
        t = self.table
        s = t.hash.slot(piece)
        return t.ids[s] if t.keys[s] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merges. A heap entry is rank * 2^shift + left end; it is stale if that end's rank has changed."""
        n, get = len(piece), self.ranks.get
        shift = n.bit_length()
        mask = (1 << shift) - 1
        pairs = self.table.pairs
        rank = [pairs[a][b] for a, b in zip(piece, piece[1:], strict=False)]  # of the part that starts at i with the next part
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << shift | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & mask
            if rank[i] != entry >> shift:
                continue
            j = after[i]
            end = after[i] = after[j]
            rank[i] = rank[j] = -1
            if end < n:
                before[end] = i
                rank[i] = r = get(piece[i : after[end]], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            p = before[i]
            if p >= 0:
                rank[p] = r = get(piece[p:end], -1)
                if r >= 0:
                    heappush(heap, r << shift | p)
        ranks, out, i = self.ranks, [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def _token(self, token: str) -> bytes:
        piece = token.encode()
        one = self.whole(piece)
        ids = self.merge(piece) if one is None else (one,)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _unit(self, unit: str) -> bytes:
        tokens = self.pattern.findall(unit)
        return self._token(tokens[0]) if len(tokens) == 1 else b"".join(map(self.tokens.__getitem__, tokens))

    def _after_blank(self, word: str) -> bytes:
        return self._unit(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if not self.gaps:
            return self._unit(text)
        words = GAP.split(text) if AWKWARD.search(text) else text.split(" ")
        head = self.first[words[0]]
        del words[0]
        return head + b"".join(map(self.later.__getitem__, words))


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def table_of(path: str) -> Table:
    return Table(ranks_of(path))


#: Encoders of this worker by the key of the broadcast they were made from, so that memos last from task to task.
_encoders: dict[str, Encoder] = {}


def encode(df: DataFrame, *, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None, pattern: str | None = None, decoded: bool = False, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Rows of `id_cols` with `ids array<int>`: the BPE ids of the whole `text_col`; with `decoded binary`, what they decode to, if asked.

    Null and empty texts give an empty array; repeated rows give repeated rows; other columns are not carried. The table of
    ranks hangs on the vocabulary alone; it is built once on the driver and broadcast. A worker remembers words of about
    `memo_bytes` and, beside, tokens and first words of five eighths of that; less memory costs time only.
    """
    pattern = pattern or default_pattern()
    text_name = unused(df, "__text")
    src = df.select(*id_cols, F.col(text_col).alias(text_name))
    pool = df.sparkSession.sparkContext.broadcast(Pool(ranks_of(ranks_path or default_ranks()))) if decoded else None
    table, gaps, key = df.sparkSession.sparkContext.broadcast(table_of(ranks_path or default_ranks())), pattern == default_pattern(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _encoders.get(key)
        if c is None:
            _encoders.clear()
            c = _encoders[key] = Encoder(table.value, pattern, gaps, memo_bytes)
        for batch in sliced(batches, text_name):
            parts = [c.encode(t) if t else b"" for t in batch.column(text_name).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))
            columns, names = [*(batch.column(k) for k in range(len(id_cols))), ids], [*id_cols, "ids"]
            if pool is not None:
                columns.append(pa.array([pool.value.decode(np.frombuffer(p, "<i4")).tobytes() for p in parts], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(df: DataFrame, *, ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """`df` with `decoded binary`: the bytes that `ids_col` stands for. Null ids give null; ids outside the vocabulary raise.

    A column `decoded` of the input is replaced.
    """
    df = df.drop("decoded")
    pool = df.sparkSession.sparkContext.broadcast(Pool(ranks_of(ranks_path or default_ranks())))
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                out = [None if x is None or not x.is_valid else pool.value.decode(x.values.to_numpy()).tobytes() for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, decoded binary")
