"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where their tokenisations provably agree.

A pre-token boundary found in a chunk is a true one if the chunk starts at a true boundary and the boundary lies a guard
distance before the chunk's end: the split pattern reads forward only, at most one character beyond a match. If the next
chunk has a pre-token boundary at the same offset, both tokenisations are the same from there on. Where the overlap of two
chunks has no such offset, it is widened until one is found or the text ends.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.bpe import AWKWARD, GAP
from kindred.llm.common import sliced

#: Characters of a chunk of a huge document, and of the first overlap of two chunks.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Bytes that a worker's memo of counted words may take (with ENTRY for each) before it starts anew.
MEMO_BYTES, ENTRY = 96 << 20, 150


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counting:
    """Counts tokens with the `tokenizers` library. Texts are parted, at word gaps or in chunks, only for vocabularies of plain byte-level pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        # special tokens aren't added, so a post-processor could only trim the offsets by which chunks are spliced
        self.t = Tokenizer.from_str(json.dumps(parts | {"post_processor": None}))
        self.t.no_padding()
        self.t.no_truncation()
        special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        #: Near a chunk's end, a cut special string or an unfinished match may make boundaries untrue.
        self.guard = 2 + max(map(len, special), default=0)
        pre = parts.get("pre_tokenizer") or {}
        #: Other pre-tokenizers or a normalizer may look across gaps, so whole texts go to the library.
        self.chunks = not parts.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        #: Gaps may split the text only if no special string holds or eats a blank.
        self.gaps = self.chunks and not any(" " in x.content or x.lstrip or x.rstrip or x.single_word for x in self.t.get_added_tokens_decoder().values())
        self.memo: dict[str, int] = {}
        self.held = 0

    def many(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.gaps:
            return self.many(texts)
        bags = [Counter(GAP.split(t) if AWKWARD.search(t) else t.split(" ")) for t in texts]
        heads = [(GAP.split(t, 1) if AWKWARD.search(t) else t.split(" ", 1))[0] for t in texts]
        for bag, head in zip(bags, heads, strict=True):  # the first word has no blank before it
            bag[head] -= 1
        every = set().union(*bags)
        new = [w for w in every if w not in self.memo]
        size = sum(map(len, new)) + ENTRY * len(new)
        if self.held + size > MEMO_BYTES:
            self.memo, self.held, new = {}, 0, list(every)
            size = sum(map(len, new)) + ENTRY * len(new)
        # a batch of too many bytes for the memo has one of its own
        memo = self.memo if size <= MEMO_BYTES else {}
        self.held += size if memo is self.memo else 0
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            memo.update(zip(part, self.many([" " + w for w in part]), strict=True))
        first = self.many(heads)
        return [n + sum(map(int.__mul__, map(memo.__getitem__, bag.keys()), bag.values())) for n, bag in zip(first, bags, strict=True)]

    def boundaries(self, text: str) -> tuple[np.ndarray, int]:
        """Offsets in `text` where a pre-token starts with the tokens before each, as rows (offset, tokens before); tokens in all."""
        e = self.t.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        rows = [(offsets[i][0], i) for i in range(len(words)) if i == 0 or words[i] != words[i - 1] or words[i] is None]
        return np.array(rows, np.int64).reshape(-1, 2), len(words)

    def huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        start, total, end = 0, 0, min(chunk, len(text))  # start: a true boundary; total: tokens before it
        while True:
            here, n = self.boundaries(text[start:end])
            if end >= len(text):
                return total + n
            width = overlap
            while True:
                begin = max(start + 1, end - width)
                stop = min(len(text), begin + chunk)
                there, m = self.boundaries(text[begin:stop])
                a = here[(here[:, 0] + start >= begin + self.guard) & (here[:, 0] + start <= end - self.guard)]
                common = np.intersect1d(a[:, 0] + start, there[:, 0] + begin)
                # the match before a boundary must end there on its own, so that at least one more match follows it in this chunk
                common = common[common < (here[-1, 0] + start if len(here) else 0)]
                if len(common):
                    at = int(common[len(common) // 2])
                    total += int(a[a[:, 0] + start == at][0, 1])
                    start, end = at, stop
                    break
                if begin == start + 1:  # no common boundary in the whole chunk: make the chunk longer
                    end = min(len(text), end + chunk)
                    break
                width *= 2


@cache
def counting(path: str) -> Counting:
    return Counting(path)


def count_tokens(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Texts over `chunk` characters are
    encoded by overlapping chunks; by a vocabulary of other than byte-level pre-tokens, all texts are encoded whole. Special strings in a text are tokens, as the library has it by default.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counting(path)
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            most = chunk if c.chunks else float("inf")
            usual = [i for i, t in enumerate(texts) if t and len(t) <= most]
            n = [0] * len(texts)
            for i, k in zip(usual, c.counts([texts[i] for i in usual]) if usual else [], strict=True):
                n[i] = k
            for i, t in enumerate(texts):
                if t and len(t) > most:
                    n[i] = c.huge(t, chunk, overlap)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
