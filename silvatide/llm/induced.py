"""External induced sorting: the suffix array and common prefixes of a shard of bytes.

Suffixes of the two types (followed by a smaller, or by a larger suffix) are
induced from the sorted sample of leftmost larger-type suffixes, as in SA-IS.
What is induced waits in a queue for each first symbol; the queues together are
a priority queue by (symbol, order of insertion), so whole blocks of tuples are
extracted and induce their predecessors at once. Queues spill to a scratch file
of the task when more is held than the memory given. The sample is sorted by the
same induction over its substrings; where their names repeat, the sequence of
names is a smaller suffix sorting problem of the same kind: it is induced again,
unless it can be sorted in the memory given.

Text, types, ranks, names and the result are arrays in memory (55 bytes a
symbol), so what is sorted at once must fit; only queues spill. Common prefixes are
not carried through the queues: neighbours are compared in the text afterwards.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

from .succinct import suffix_array
from .textops import mix

MEMORY = 256 << 20
#: Memory that prefix doubling takes, in arrays as long as its sequence.
BASE = 12


class Queues:
    """First-in first-out queues of positions, one for each symbol; held in memory up to a limit, then in a scratch file."""

    def __init__(self, limit: int = MEMORY):
        self.limit, self.size = limit, 0
        self.parts: dict[int, list] = defaultdict(list)
        self.file = None

    def push(self, symbol: int, positions: np.ndarray) -> None:
        if not len(positions):
            return
        if self.size + positions.nbytes > self.limit:
            self._spill()
        self.parts[symbol].append(positions)
        self.size += positions.nbytes

    def push_all(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Push each position to its symbol's queue, keeping their order."""
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        s, p = symbols[order], positions[order]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(s)], strict=True):
            self.push(int(s[a]), p[a:b])

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts.values():
            for k, x in enumerate(parts):
                if isinstance(x, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(x.tobytes())
                    parts[k] = (at, len(x), x.dtype)
        self.size = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All that waits under a symbol, in order of insertion."""
        got = []
        for x in self.parts.pop(symbol, []):
            if isinstance(x, tuple):
                self.file.seek(x[0])
                got.append(np.frombuffer(self.file.read(x[1] * x[2].itemsize), x[2]))
            else:
                self.size -= x.nbytes
                got.append(x)
        return np.concatenate(got) if got else np.zeros(0, np.int64)

    def symbols(self) -> list[int]:
        return sorted(self.parts)


def larger_type(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last symbol is the unique least one."""
    up = np.zeros(len(t), bool)
    differs = np.flatnonzero(t[1:] != t[:-1])
    if len(differs):
        up[: differs[-1] + 1] = np.repeat(t[differs] < t[differs + 1], np.diff(differs, prepend=-1))
    up[-1] = True
    return up


def induce(t: np.ndarray, up: np.ndarray, sample: np.ndarray, limit: int = MEMORY) -> np.ndarray:
    """All suffixes in order, from the sample (leftmost positions of runs of larger type) in order."""
    low, seeds, lows = Queues(limit), Queues(limit), Queues(limit)
    seeds.push_all(t[sample], sample)
    alphabet = np.unique(t).tolist()
    # The symbol before each position if its suffix is of the smaller, or of the larger type; else -1.
    before = np.concatenate([[-1], t[:-1]]).astype(np.int16 if t.dtype == np.uint8 else np.int64)
    before_low, before_high = before.copy(), before
    before_low[1:][up[:-1]] = -1
    before_high[1:][~up[:-1]] = -1
    for c in alphabet:
        block = low.pop(c)
        while len(block):
            lows.push(c, block)
            s = before_low[block]
            own = s >= 0
            p, s = block[own] - 1, s[own]
            same = s == c
            low.push_all(s[~same], p[~same])
            block = p[same]
        star = seeds.pop(c)
        p = star[star > 0] - 1
        low.push_all(t[p], p)
    high, out = Queues(limit), []
    for c in reversed(alphabet):
        block, made = high.pop(c), []
        if c == alphabet[0]:
            block = np.array([len(t) - 1])  # the last symbol is a suffix of larger type that nothing induces
        while len(block):
            made.append(block)
            s = before_high[block]
            own = s >= 0
            p, s = block[own] - 1, s[own]
            same = s == c
            high.push_all(s[~same], p[~same])
            block = p[same]
        lower = lows.pop(c)
        if made:
            out.append(np.concatenate(made)[::-1])
        if len(lower):
            out.append(lower)
        back = lower[::-1]
        s = before_high[back]
        own = s >= 0
        high.push_all(s[own], back[own] - 1)
    return np.concatenate(out[::-1])


def sort_suffixes(t: np.ndarray, limit: int = MEMORY) -> np.ndarray:
    """The suffix array of a sequence whose last symbol is its unique least one."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    up = larger_type(t)
    starts = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(starts) <= 1:
        return induce(t, up, starts if len(starts) else np.array([n - 1]), limit)
    order = induce(t, up, starts, limit)
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    order = order[is_start[order]]
    # Names: equal substrings between sample positions get equal ones.
    end = np.append(starts[1:], n - 1)
    where = np.full(n, -1, np.int64)
    where[starts] = np.arange(len(starts))
    place = where[order]
    digest = _digests(t, starts, end + 1)[place]
    size = (end - starts)[place]
    fresh = np.concatenate([[True], (digest[1:] != digest[:-1]) | (size[1:] != size[:-1])])
    names = np.cumsum(fresh) - 1
    if names[-1] + 1 < len(starts):
        reduced = np.empty(len(starts), np.int64)
        reduced[place] = names
        # The base case is what can be sorted in the memory given.
        order = starts[suffix_array(reduced) if BASE * reduced.nbytes <= limit else sort_suffixes(reduced, limit)]
    return induce(t, up, order, limit)


def _digests(t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from .textops import powers

    up, down = powers(len(t))
    s = np.zeros(len(t) + 1, np.uint64)
    code = mix(np.arange(1, 257, dtype=np.uint64))[t] if t.dtype == np.uint8 else mix(t.astype(np.uint64) + np.uint64(1))
    np.cumsum(code * up[: len(t)], out=s[1:])
    return (s[end] - s[start]) * down[start]


def common_prefix_reaches(t: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares `length` symbols with the one before it in the array. Symbols are compared eight at a time where t is bytes."""
    n = len(t)
    out = np.zeros(len(sa), bool)
    a, b = sa[1:], sa[:-1]
    live = np.flatnonzero(np.maximum(a, b) + length <= n)
    step, blocks = 1, t
    if length >= 8 and n >= 8 and t.dtype == np.uint8:
        step, blocks = 8, np.ndarray(n - 7, np.uint64, np.ascontiguousarray(t), strides=(1,)).copy()
    for k in range(0, length, step):
        k = min(k, length - step)
        live = live[blocks[a[live] + k] == blocks[b[live] + k]]
    out[live + 1] = True
    return out
