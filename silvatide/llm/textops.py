"""Vectorised text primitives shared by the corpus operators.

Everything works on the raw UTF-8 bytes of an Arrow string column, a bounded
chunk of documents at a time, so that no Python string is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes from which a span is hashed by the library, one by one.
LONG = 64

_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _table(keep) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for c in range(256):
        low = c + 32 if 65 <= c <= 90 else c
        if keep(low):
            t[c] = low
    return t


#: Lower-cased byte, or 0 where a byte separates words: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = _table(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
#: The same for `[^\x20\x09-\x0D]+`; a NUL byte counts as byte 255, which UTF-8 never holds.
NONSPACE = _table(lambda c: not (c == 32 or 9 <= c <= 13))
NONSPACE[0] = 255


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> _U(30))  # a copy; the rest is done in place
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The first column of that name: a table may hold extra columns with clashing names."""
    return batch.column(batch.schema.get_all_field_indices(name)[0])


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of bytes. Spans of at most 7 bytes never share one; up to LONG bytes their eight-byte
    blocks are scrambled one after another, all spans together; longer ones get a BLAKE2b digest."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    short = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def block(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(blocks[at]).view(np.uint64).ravel() & short[np.minimum(left, 8)]

    h = mix(block(start, size) ^ (np.minimum(size, 8).astype(np.uint64) << _U(56)))
    live, k = np.flatnonzero(size >= 8), 8
    while len(live) and k <= LONG:
        left = size[live] - k
        h[live] = mix(h[live] * _U(_BASE) + mix(block(start[live] + np.minimum(k, size[live]), np.maximum(left, 0)) + np.minimum(size[live], 1 << 40).astype(np.uint64)))
        live, k = live[left > 8], k + 8
    for x in np.flatnonzero(size > LONG).tolist():
        h[x] = int.from_bytes(hashlib.blake2b(data[start[x] : end[x]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether span i of a and span i of b hold the same bytes."""
    size = a_end - a_start
    out = size == b_end - b_start
    pick = np.flatnonzero(out & (size > 0))
    n = size[pick]
    if len(n):
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        equal = a[step + np.repeat(a_start[pick], n)] == b[step + np.repeat(b_start[pick], n)]
        out[pick] = np.logical_and.reduceat(equal, ends - n)
    return out


class Words:
    """The words of the rows of a chunk, as byte spans and 64-bit hashes.

    first[i] : first[i + 1] are row i's words.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray = ALNUM):
        n = len(data)
        code = table[data]
        w = code != 0
        edge = off[(off > 0) & (off < n)]
        prev = np.zeros(n, bool)
        prev[1:] = w[:-1]
        prev[edge] = False
        after = np.zeros(n, bool)
        after[:-1] = w[1:]
        after[edge - 1] = False
        self.code = code
        self.start = np.flatnonzero(w & ~prev)
        self.end = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, prefix: int = 0) -> np.ndarray:
        """A hash for each word, or for its first `prefix` bytes."""
        return hash_spans(self.code, self.start, np.minimum(self.end, self.start + prefix) if prefix else self.end)

    def spelled(self, at: np.ndarray, words: list[bytes], which: np.ndarray) -> np.ndarray:
        """Whether word at[i] is words[which[i]], byte by byte."""
        size = np.array([len(w) for w in words], np.int64)
        pool = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        return same_spans(self.code, self.start[at], self.end[at], pool, begin[which], begin[which] + size[which])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that Words gives to these (already lower-cased) words."""
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
    return hash_spans(np.frombuffer(b"".join(words), np.uint8), begin, end)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of each row (a shorter row is one shingle) and their row bounds."""
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + np.repeat(first[:-1], count)
    out = np.zeros(len(at), np.uint64)
    if len(at):
        left = np.minimum(np.repeat(n, count), k)
        for j in range(k):
            ok = left > j
            step = h[np.minimum(at + j, len(h) - 1)]
            out = np.where(ok, mix(out * _U(0xD6E8FEB86659FD93) + step), out)
    return out, bounds
