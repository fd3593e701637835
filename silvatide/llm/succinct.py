"""Succinct bit vectors, the wavelet matrix and the FM-index, all with vectorised queries."""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64


#: Words of a superblock, and ones (or zeros) between samples of their positions.
SUPER, SAMPLE = 8, 4096


class BitVector:
    """Packed bits with rank and select.

    Built in memory, a count before every 64-bit word answers a rank in two look-ups. Read from a file, the counts are
    those before every superblock of SUPER words, and the words between are counted when asked; samples of the positions
    of ones and of zeros narrow a select.
    """

    def __init__(self, words: np.ndarray, n: int, supers: np.ndarray | None = None, samples: tuple[np.ndarray, np.ndarray] | None = None):
        self.words, self.n, self.samples = words, n, samples
        self.supers, self.before = supers, None
        if supers is None:
            self.before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=self.before[1:])
            self.ones = int(self.before[-1])
        else:
            last = len(words) - 1
            self.ones = int(supers[last // SUPER]) + int(np.bitwise_count(words[last // SUPER * SUPER :]).sum())

    @staticmethod
    def of(bits: np.ndarray) -> BitVector:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw[: len(packed)] = packed
        return BitVector(raw.view(np.uint64), n)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i, for 0 <= i <= n."""
        w = i >> 6
        part = np.bitwise_count(self.words[w] & ((_U(1) << (i & 63).astype(np.uint64)) - _U(1)))
        if self.before is not None:
            return self.before[w] + part
        out = self.supers[w // SUPER].astype(np.int64) + part
        first = w // SUPER * SUPER
        for k in range(SUPER - 1):
            inside = first + k < w
            out += np.where(inside, np.bitwise_count(self.words[np.minimum(first + k, w)]), 0)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & _U(1)).astype(bool)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero, by bisection over ranks between two samples."""
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        if self.samples is not None:
            at = self.samples[int(one)].astype(np.int64)
            slot = k // SAMPLE
            lo = at[slot]
            hi = np.where(slot + 1 < len(at), at[np.minimum(slot + 1, len(at) - 1)], self.n)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            r = self.rank1(mid + 1)
            r = r if one else mid + 1 - r
            go = (r > k) | (lo >= hi)
            hi = np.where(go, np.minimum(mid, hi), hi)
            lo = np.where(go, lo, mid + 1)
        return lo

    def directory(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts before superblocks, and sampled positions of zeros and of ones, as 32-bit integers."""
        samples = (self.select(np.arange(0, most, SAMPLE), one).astype("<u4") for most, one in ((self.n - self.ones, False), (self.ones, True)))
        return self.before[:-1][::SUPER].astype("<u4"), *samples


class WaveletMatrix:
    """A sequence of integers below 2 ** depth as bit planes, most significant first; each plane is in the order that
    stably sorting by the planes above gives, zeros first."""

    MAGIC = b"WVM2"

    def __init__(self, planes: list[BitVector], n: int):
        self.planes, self.n, self.depth = planes, n, len(planes)
        self.zeros = [n - p.ones for p in planes]

    @staticmethod
    def of(values: np.ndarray, depth: int) -> WaveletMatrix:
        planes, v = [], values
        for level in range(depth - 1, -1, -1):
            bit = ((v >> v.dtype.type(level)) & v.dtype.type(1)).view(np.uint8 if v.itemsize == 1 else v.dtype).astype(bool)
            planes.append(BitVector.of(bit))
            if level:
                v = np.concatenate([v[~bit], v[bit]])
        return WaveletMatrix(planes, len(values))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        out, i = np.zeros(len(i), np.int64), i.astype(np.int64)
        for p, z in zip(self.planes, self.zeros, strict=True):
            bit, r = p.get(i), p.rank1(i)
            i = np.where(bit, z + r, i - r)
            out = (out << 1) | bit
        return out

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each value stands before position i."""
        lo, hi = np.zeros(len(value), np.int64), i.astype(np.int64)
        for level, (p, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = (value >> (self.depth - 1 - level)) & 1 != 0
            a, b = p.rank1(lo), p.rank1(hi)
            lo, hi = np.where(bit, z + a, lo - a), np.where(bit, z + b, hi - b)
        return hi - lo

    def count(self, value: int) -> int:
        return int(self.rank(np.array([value]), np.array([self.n]))[0])

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of a value, in order: select on every plane, from the last upward."""
        lo, hi = 0, self.n
        for level, (p, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = (int(x) for x in p.rank1(np.array([lo, hi])))
            lo, hi = (z + a, z + b) if value >> (self.depth - 1 - level) & 1 else (lo - a, hi - b)
        at = np.arange(lo, hi, dtype=np.int64)
        for level in range(self.depth - 1, -1, -1):
            one = bool(value >> (self.depth - 1 - level) & 1)
            at = self.planes[level].select(at - self.zeros[level] if one else at, one)
        return np.sort(at)

    def decode(self, dtype=np.uint16) -> np.ndarray:
        """The whole sequence: undo the stable partitions from the last plane upward."""
        v = np.zeros(self.n, dtype)
        for level in range(self.depth - 1, -1, -1):
            bit = self.planes[level].bits()
            z = self.zeros[level]
            up = np.empty_like(v)
            up[~bit] = v[:z]
            up[bit] = v[z:] | dtype(1 << (self.depth - 1 - level))
            v = up
        return v

    def dump(self) -> bytes:
        """MAGIC, then little-endian 64-bit integers: depth, length, and for each plane the numbers of its sampled zeros and ones;
        then for each plane its words, its superblock counts and its samples of zeros and of ones. Nothing is counted again on reading."""
        made = [p.directory() for p in self.planes]
        head = struct.pack(f"<QQ{2 * self.depth}Q", self.depth, self.n, *[len(x) for d in made for x in d[1:]])
        body = [x.tobytes() for p, d in zip(self.planes, made, strict=True) for x in (p.words, *d)]
        return b"".join([self.MAGIC, head, *body])

    @staticmethod
    def load(raw: bytes) -> WaveletMatrix:
        if raw[:4] != WaveletMatrix.MAGIC:
            raise ValueError("not a wavelet matrix")
        depth, n = struct.unpack_from("<QQ", raw, 4)
        sizes = struct.unpack_from(f"<{2 * depth}Q", raw, 20)
        at, n_words, planes = 20 + 16 * depth, n // 64 + 1, []
        n_supers = -(-n_words // SUPER)
        for k in range(depth):
            words = np.frombuffer(raw, np.uint8, 8 * n_words, at).copy().view(np.uint64)
            at += 8 * n_words
            parts = []
            for size in (n_supers, sizes[2 * k], sizes[2 * k + 1]):
                parts.append(np.frombuffer(raw, np.uint8, 4 * size, at).copy().view("<u4"))
                at += 4 * size
            planes.append(BitVector(words, n, parts[0], (parts[1], parts[2])))
        return WaveletMatrix(planes, n)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence in order, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    # As many symbols as fit a word are compared at once; 0 stands after the end.
    bits = (int(seq.max()) + 1).bit_length()
    key, h = seq.astype(np.int64) + 1, 1
    while 2 * h * bits < 64 and h < n:
        key <<= h * bits
        key[:-h] |= key[h:] >> h * bits
        h *= 2
    sa = np.argsort(key)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    while True:
        # Positions of sa in a group of more than one.
        alone = new & np.concatenate([new[1:], [True]])
        open_ = np.flatnonzero(~alone)
        if not len(open_) or h >= n:
            return sa
        at = sa[open_]
        nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        pair = group[open_] * (n + 1) + nxt
        order = np.argsort(pair)
        sa[open_] = at[order]
        pair = pair[order]
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[open_] = fresh
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa[open_]] = group[open_]
        h *= 2


class FMIndex:
    """Over a sequence of integers below 2 ** depth. Counting and locating are done for many patterns at once."""

    def __init__(self, seq: np.ndarray, sample: int = 16):
        seq = np.concatenate([seq.astype(np.int64) + 1, [0]])  # 0 ends the sequence
        self.n = n = len(seq)
        sa = suffix_array(seq)
        self.depth = max(1, int(seq.max()).bit_length())
        self.bwt = WaveletMatrix.of(seq[sa - 1], self.depth)
        self.less = np.zeros((1 << self.depth) + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=1 << self.depth), out=self.less[1:])
        marked = sa % sample == 0
        self.marked, self.samples = BitVector.of(marked), sa[marked]

    def ranges(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes begin with each pattern: `length` symbols of `text` from each start. Patterns that occur no more are left."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        live = np.arange(len(starts))
        for j in range(length - 1, -1, -1):
            c = text[starts[live] + j].astype(np.int64) + 1
            known = c < 1 << self.depth
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live], hi[live] = self.less[c] + self.bwt.rank(c, lo[live]), self.less[c] + self.bwt.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back through the sequence to a sampled position."""
        out, steps, row = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked.get(row[todo])
            done = todo[hit]
            out[done] = self.samples[self.marked.rank1(row[done])] + steps[done]
            todo = todo[~hit]
            c = self.bwt.access(row[todo])
            row[todo] = self.less[c] + self.bwt.rank(c, row[todo])
            steps[todo] += 1
        return out
