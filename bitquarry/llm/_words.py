"""Words of whole texts as flat numpy arrays.

A word is a maximal run of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. Texts come as
the data and offset buffers of an Arrow string column, so no Python object is made per document or per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer document is worked on alone, in pieces of this size.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) * 8 + 5
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: What each byte becomes: upper case to lower case, what separates words to a space.
NORMAL = np.full(256, 32, np.uint8)
NORMAL[48:58] = np.arange(48, 58)
NORMAL[97:123] = np.arange(97, 123)
NORMAL[65:91] = np.arange(97, 123)
NORMAL[128:] = np.arange(128, 256)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, which spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])
        return self.up, self.down


POWERS = _Powers(_BASE)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash H with H[j] - H[i] = sum of data[i:j] times the powers i to j-1."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end), mixed; equal substrings have equal hashes."""
    _, down = POWERS.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


class Words(NamedTuple):
    norm: np.ndarray  # normalised bytes of all texts
    start: np.ndarray  # of each word in norm
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words at the end
    code: np.ndarray  # 64-bit hash of each word

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, a: int, b: int) -> bytes:
        """The words a to b-1 with a space between them."""
        return b" ".join(self.norm[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts data[offsets[i]:offsets[i+1]]."""
    norm = NORMAL[data]
    inside = norm != 32
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    first = np.searchsorted(start, offsets)
    code = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # in pieces of bounded size, of whole words
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        lo, hi = start[i], end[j - 1]
        code[i:j] = substring_hash(prefix_hash(norm[lo:hi]), start[i:j] - lo, end[i:j] - lo)
        i = j
    return Words(norm, start, end, first, code)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges [i, j) of whole texts of about ``limit`` bytes, with their data and offsets; null counts as empty."""
    texts = batch.column(column)
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and each one's document. A text of 1 to n-1 words is one shingle."""
    count = np.diff(w.first)
    total = len(w.code)
    code = np.zeros(max(0, total - n + 1), np.uint64)
    for j in range(n):
        code += w.code[j : total - n + 1 + j] * _SHINGLE[j] if total >= n else 0
    doc = w.doc()
    whole = np.flatnonzero(count >= n)
    keep = np.zeros(total, bool)
    if len(whole):
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, w.first[whole], 1)
        np.add.at(edge, w.first[whole + 1] - n + 1, -1)
        keep = np.cumsum(edge[:-1]) > 0
    at = np.flatnonzero(keep)
    short = np.flatnonzero((count > 0) & (count < n))
    rest = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        has = count[short] > j
        rest[has] += w.code[w.first[short[has]] + j] * _SHINGLE[j]
    rest += count[short].astype(np.uint64) * _SHINGLE[63]
    return mix(np.concatenate([code[at], rest])), np.concatenate([doc[at], short])
