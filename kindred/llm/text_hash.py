"""Words of texts and hashes of word runs; the same on every machine.

A word's hash is XXH3 of its bytes. Runs of words are hashed by a seeded polynomial over word hashes, which is good for
sampling and for sets of short shingles; where equality decides, use `digests`, which is of the words themselves.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b

import numpy as np
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of words (with what their entries take) that a worker remembers the hashes of.
MEMO_BYTES = 16 << 20
ENTRY = 200


class WordHashes(dict):
    """64-bit hash of each word, computed once while remembered; forgets all when its bound of bytes is reached."""

    def __init__(self, bound: int = MEMO_BYTES):
        super().__init__()
        self.bound, self.held = bound, 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        size = len(word) + ENTRY
        if size < self.bound >> 4:
            if self.held + size > self.bound:
                self.clear()
                self.held = 0
            self[word] = h
            self.held += size
        return h


@cache
def _memo() -> WordHashes:
    return WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo().__getitem__, words), U, len(words))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hash of every word of the texts, one after the other; where each text's words begin (one more at the end); the words.

    `bytes.split` parts at space and the ASCII controls 9 to 13, no more.
    """
    split = [t.split() for t in texts]
    flat = [w for s in split for w in s]
    return word_hashes(flat), np.cumsum([0, *map(len, split)]), flat


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, BASE, U), np.full(size, pow(BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        p = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
        if size > 1 << 20:
            return p[0], p[1]
        _powers[:] = p
    return _powers[0], _powers[1]


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * BASE^i, with a leading 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans(s: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of values[start:stop] from `sums`."""
    return mixed((s[stop] - s[start]) * powers(len(s))[1][start] + (stop - start).astype(U) * U(0xD6E8FEB86659FD93))


def digests(flat: list[bytes], start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """128-bit BLAKE2b digest of the words flat[start:stop], joined by one space, for each start and stop."""
    joined = memoryview(b" ".join(flat))
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
    begin = np.concatenate([[0], ends])[start].tolist()
    return [blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begin, (ends[stop - 1] - 1).tolist(), strict=True)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of runs of k words of one text, sorted; of the whole text if it has fewer words; none without words."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    at = np.arange(n)
    return np.unique(spans(sums(h), at, np.minimum(at + k, len(h))))
