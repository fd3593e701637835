"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put in bands by size, so that linked sets lie in one
band or in two neighbouring ones. At the level of a band, two linked sets differ
in at most k shingles. The domain of hashes is cut into partitions, few enough
that one of them holds at most d differences, and each partition into parts, so
that there all parts but d agree: every subset of that many parts is enumerated,
and its content, hashed, is a signature. Linked sets share one.

Copies (equal sets) are first reduced to the one of least id. Signatures of one
set only are dropped. Each other one's sets are compared with its least set (a
star, not all pairs). Signatures that after joining these links still hold sets
of different components have their pairs across components compared, each once
for all signatures with the same least set; where many sets share that, longer
sketches leave few of them open. If a signature is shared by so many
sets that this would be too much, its sets are signed again by a scheme whose
signatures stand for more shingles, and so hold fewer sets that do not link.
Every comparison that exact bounds (size, a parity sketch, counts in parts of the
domain) do not rule out is made on the whole texts.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .tables import arrow_map, delete, only, table, written
from .textops import NONSPACE, Words, chunks, column, mix, shingles, text_buffer

_U = np.uint64
BUCKETS = 1024
SKETCH = 4  # 64-bit words of the parity sketch
#: Bits of the long parity sketch at most; it has as many as the set has shingles, and less than twice as many.
LONG_BITS = 1 << 15
#: Shingles that a signature of a typical set stands for, round by round.
CONTENT = (4.5, 9.0, 16.0)
#: A shared signature of more sets than this, where its star does not join them all, is taken apart by the next round's signatures.
LARGE = 32
#: Cuts of the domain that a set may try, one after another, until few of its partitions are thin.
CUTS = 4
#: The signatures are made and matched in so many slices, one after another, which bounds the disk they take.
SLICES = 2
#: Signatures of a set at a level, at most, as a multiple of its size, if there is a choice.
MOST = 0.6


@dataclass(frozen=True)
class Scheme:
    """outer partitions of the domain, each of `inner` parts; every subset of `size` parts of a partition is a signature.

    A subset is thin if it holds fewer than `least` shingles, a partition is thin if one of its subsets is; a set may have
    `spare` thin partitions and still need no thin signatures.
    """

    outer: int
    inner: int
    size: int
    least: int
    spare: int

    @property
    def count(self) -> int:
        return self.outer * math.comb(self.inner, self.size)


def _tail(mean: float, top: int) -> float:
    """The share of a Poisson distribution above `top`."""
    term = total = math.exp(-mean)
    for j in range(1, top + 1):
        term *= mean / j
        total += term
    return max(0.0, 1.0 - total)


@lru_cache(maxsize=4096)
def choose_scheme(k: int, typical: float, content: float) -> Scheme:
    """For sets that differ in at most k shingles. Of `outer` partitions at most k // (d + 1) hold more than d differences, so
    1 + spare hold at most d each: linked sets agree there on at least inner - d parts, so on a whole subset of that size.

    Of the schemes whose signatures stand for `content` shingles of a typical set the one of fewest signatures, those of
    further cuts included; if none does, the one that comes nearest with no more than MOST signatures a shingle.
    """
    best = None
    for d in range(1, 8):
        for inner in range(d + 2, d + 6):
            size, ways = inner - d, math.comb(inner, d)
            for spare in range(k // (d + 1) // 3 + 2):
                outer = k // (d + 1) + 1 + spare
                if best is not None and not best[0][0] and outer * ways * 1.02**-3 > best[0][1]:
                    break  # more partitions only cost more
                mean = typical * size / (outer * inner)
                found = False
                for least in (1, 2, 3):
                    thin = outer * min(1.0, ways * (1.0 - _tail(mean, least - 1)))
                    again = _tail(thin, spare) if thin <= spare + 1 else 1.0  # the median is near the mean
                    # A larger least content is taken where it costs next to nothing.
                    if again > (0.5 if least == 1 else 0.02):
                        break
                    count = outer * ways * (1.0 + again)
                    if count > max(32.0, MOST * typical):
                        continue
                    found = True
                    rank = (mean < content, count * 1.02 ** -least if mean >= content else -mean, count)
                    if best is None or rank < best[0]:
                        best = (rank, Scheme(outer, inner, size, least, spare))
                if found and mean < content:
                    break  # and stand for less
    return best[1] if best else Scheme(k // 2 + 1, 3, 2, 1, 0)


class Bands:
    """Size bands, and the scheme of each level in each round."""

    def __init__(self, share: Fraction):
        self.share = share
        self.tops = [1]
        self.made: dict[tuple[int, int], Scheme | None] = {}

    def band(self, n: int) -> int:
        p, q = self.share.numerator, self.share.denominator
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * q // p))
        return bisect.bisect_left(self.tops, n)

    def scheme(self, level: int, turn: int) -> Scheme | None:
        """None where linked sets are equal; then a set's one signature is the whole of it."""
        p, q = self.share.numerator, self.share.denominator
        while len(self.tops) <= level:
            self.band(self.tops[-1] + 1)
        if (level, turn) not in self.made:
            k = 2 * self.tops[level] * (q - p) // (q + p)
            typical = (self.tops[max(level - 2, 0)] + self.tops[max(level - 1, 0)]) / 2  # of the lower band
            self.made[level, turn] = choose_scheme(k, typical, CONTENT[turn]) if k else None
        return self.made[level, turn]


@lru_cache(maxsize=4096)
def _edges(m: int) -> np.ndarray:
    return np.array([(j << 64) // m for j in range(1, m)], np.uint64)


@lru_cache(maxsize=4096)
def _subsets(inner: int, size: int) -> np.ndarray:
    """Which parts each subset takes."""
    out = np.zeros((math.comb(inner, size), inner), np.uint64)
    for row, parts in enumerate(combinations(range(inner), size)):
        out[row, parts] = 1
    return out


@lru_cache(maxsize=4096)
def _salts(level: int, turn: int, cut: int, s: Scheme) -> np.ndarray:
    """A number for each signature of a level, round and cut."""
    n = np.arange(s.count, dtype=np.uint64).reshape(s.outer, -1)
    return mix(n + (_U(level + 1) << _U(32)) + (_U(turn * CUTS + cut) << _U(48)))


def signatures(s: np.ndarray, bands: Bands, turn: int = 0) -> np.ndarray:
    """The signatures of a sorted set of hashes, at the level of its band and at the next.

    A set with more than `spare` thin partitions tries another cut of the domain as well, on and on; in its last one it
    gives its thin signatures too. Of two linked sets let a be the one that stops first, at some cut. There they agree on
    a subset of a partition that is not thin for a, and both give its signature.
    """
    if not len(s):
        return np.zeros(0, np.uint64)
    band, out = bands.band(len(s)), []
    made: list[tuple[np.ndarray, np.ndarray]] = []  # of each cut the hashes in order, and sums of their scrambles
    for level in (band, band + 1):
        x = bands.scheme(level, turn)
        if x is None:
            out.append(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + _U(level)))
            continue
        pick = _subsets(x.inner, x.size).T
        for cut in range(CUTS):
            if cut == len(made):
                v = s if cut == 0 else np.sort(mix(s ^ _U(cut * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
                sums = np.zeros(len(v) + 1, np.uint64)
                np.cumsum(mix(v + _U(0x5851F42D4C957F2D)), out=sums[1:])
                made.append((v, sums))
            v, sums = made[cut]
            at = np.empty(x.outer * x.inner + 1, np.int64)
            at[0], at[1:-1], at[-1] = 0, np.searchsorted(v, _edges(x.outer * x.inner)), len(v)
            part = sums[at]
            held = (at[1:] - at[:-1]).astype(np.uint64).reshape(x.outer, x.inner) @ pick
            sig = mix((part[1:] - part[:-1]).reshape(x.outer, x.inner) @ pick ^ _salts(level, turn, cut, x))
            thick = held >= x.least
            done = x.outer - int(thick.all(1).sum()) <= x.spare
            out.append(sig[thick] if done or cut < CUTS - 1 else sig.ravel())
            if done:
                break
    return np.concatenate(out)


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = text_buffer(texts)
    for i, j in chunks(off):
        w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], NONSPACE)
        h, bounds = shingles(w.hashes(), w.first, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s = np.sort(h[a:b])
            new = np.ones(b - a, bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both)


def _long_sketch(s: np.ndarray) -> bytes:
    """A parity sketch that grows with the set. The halves of a longer one make a shorter one of the same set."""
    bits = min(max(1 << (len(s) - 1).bit_length(), 64 * SKETCH), LONG_BITS) if len(s) else 64 * SKETCH
    odd = np.bincount((s >> _U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """For each pair of long sketches a bound from below on the number of shingles in which the sets differ."""
    out = np.zeros(len(one), np.int64)
    size = np.array([(len(x), len(y)) for x, y in zip(one, other, strict=True)], np.int64).reshape(-1, 2)
    for a, b in np.unique(size, axis=0).tolist():
        at = np.flatnonzero((size[:, 0] == a) & (size[:, 1] == b))
        for x in range(0, len(at), 4096):
            part = at[x : x + 4096]
            u, v = (np.frombuffer(b"".join([side[j] for j in part.tolist()]), np.uint64).reshape(len(part), -1) for side in (one, other))
            while u.shape[1] != v.shape[1]:
                u, v = (u, v) if u.shape[1] > v.shape[1] else (v, u)
                u = u[:, : u.shape[1] // 2] ^ u[:, u.shape[1] // 2 :]
            out[part] = np.bitwise_count(u ^ v).sum(1, dtype=np.int64)
    return out


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and its parity sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, sketch, long = [], [], [], []
            for s in sets_of(column(b, "text"), k):
                n.append(len(s))
                digest.append((int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ _U(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64))))
                odd = np.bincount((s >> _U(7)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
                sketch.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
                long.append(_long_sketch(s))
            d = np.array(digest, np.uint64).reshape(-1, 2).view(np.int64)
            sk = np.array(sketch, np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array(sk[:, c]) for c in range(SKETCH)), pa.array(long, pa.binary())],
                names=["doc_id", "n_shingles", "d0", "d1", *(f"s{c}" for c in range(SKETCH)), "sketch"],
            )

    return arrow_map(docs, run, "doc_id long, n_shingles long, d0 long, d1 long, " + ", ".join(f"s{c} long" for c in range(SKETCH)) + ", sketch binary")


def _signature_rows(docs: DataFrame, k: int, share: Fraction, turn: int, slice_: int) -> DataFrame:
    """sig, doc, and n, least: the number of sets that share the signature (two at least) and the smallest id of them. One of SLICES of all signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(share)
        for b in batches:
            ids = column(b, "doc_id").to_numpy(zero_copy_only=False)
            held, own, size, at = [], [], 0, 0
            for j, s in enumerate(sets_of(column(b, "text"), k)):
                sig = signatures(s, bands, turn)
                sig = sig[sig % _U(SLICES) == _U(slice_)]
                held.append(sig)
                own.append(len(sig))
                size += len(sig)
                if size >= 1 << 18 or j == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.repeat(ids[at : at + len(own)], own).astype(np.int64))], names=["sig", "doc"])
                    held, own, size, at = [], [], 0, at + len(own)

    same = Window.partitionBy("sig")
    rows = arrow_map(docs, run, "sig long, doc long")
    return rows.select("sig", "doc", F.count("*").over(same).alias("n"), F.min("doc").over(same).alias("least")).filter("n > 1")


_BOUNDS = ["n_shingles", *(f"s{c}" for c in range(SKETCH))]


def _side(profiles: DataFrame, x: str) -> DataFrame:
    """What the bounds need of each document, its columns beginning with x."""
    return profiles.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in _BOUNDS]).dropDuplicates([x, f"{x}_n_shingles", f"{x}_s0"])


def _open(share: Fraction) -> F.Column:
    """Whether sizes and sketches leave a pair (a, b) open; both are bounds, so no link is lost."""
    p, q = share.numerator, share.denominator
    n = F.col("a_n_shingles") + F.col("b_n_shingles")
    size = q * F.least("a_n_shingles", "b_n_shingles") >= p * F.greatest("a_n_shingles", "b_n_shingles")
    apart = sum((F.bit_count(F.col(f"a_s{c}").bitwiseXOR(F.col(f"b_s{c}"))) for c in range(1, SKETCH)), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    return size & (apart * (q + p) <= n * (q - p))


#: Pairs made at once, and rows gathered before they are made.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 1 << 16
#: Tasks that the signatures of one least set are dealt to, at most, and rows that each of them is to have at least.
SPREAD, DEAL_ROWS = 16, 1 << 14
#: Where more sets than this have signatures of one least set, their pairs are held against the long sketches too: fewer have few pairs a set.
MANY = 64


def _pairs(rows: DataFrame, sketches: DataFrame, share: Fraction) -> DataFrame:
    """Pairs a < b of a signature's sets that lie in different components and that the bounds leave open.

    rows: least, sig, doc, comp and the bounds of doc. sketches: doc, sketch. Signatures of the same least set meet in one task, in
    up to SPREAD if they are many, and a set's pairs are made for all of its signatures there at once, so that a pair that many of
    them hold is given once a task. A set's sketch goes once to each task that may ask for it, ahead of the signatures.
    """
    p, q = share.numerator, share.denominator

    def stops(new: np.ndarray) -> np.ndarray:
        """For each row the end of its run."""
        edge = np.append(np.flatnonzero(new), len(new))
        return np.repeat(edge[1:], np.diff(edge))

    def make(t: pa.Table, known: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        least, sig, doc, comp, n, *sketch = (t.column(c).to_numpy() for c in ("least", "sig", "doc", "comp", *_BOUNDS))
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (least[1:] != least[:-1])
        stop = stops(new)
        new[1:] |= comp[1:] != comp[:-1]
        past = stops(new)  # where the sets of the same signature in other components begin that follow
        order = np.argsort(doc, kind="stable")
        more = (stop - past)[order]
        ends = np.cumsum(more)
        edges = np.append(np.flatnonzero(np.diff(doc[order])) + 1, len(sig))  # ends of a set's rows
        at = 0
        while at < len(sig):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right"))
            to = int(edges[max(np.searchsorted(edges, at, "right"), np.searchsorted(edges, to, "right") - 1)])
            m = more[at:to]
            x = np.repeat(order[at:to], m)
            y = past[x] + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
            keep = q * np.minimum(n[x], n[y]) >= p * np.maximum(n[x], n[y])
            x, y = x[keep], y[keep]
            apart = sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in sketch) if len(x) else np.zeros(0, np.int64)
            keep = apart * (q + p) <= (n[x] + n[y]) * (q - p)
            x, y = x[keep], y[keep]
            a, b = doc[x], doc[y]
            both, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True) if len(a) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            held = [(known.get(a), known.get(b)) for a, b in both.tolist()] if known else []
            asked = np.array([j for j, (u, v) in enumerate(held) if u is not None and v is not None], np.int64)
            if len(asked):
                apart = _apart([held[j][0] for j in asked.tolist()], [held[j][1] for j in asked.tolist()])
                total = (n[x] + n[y])[first[asked]]
                both = np.delete(both, asked[apart * (q + p) > total * (q - p)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, c])) for c in (0, 1)], names=["a", "b"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        known: dict[int, bytes] = {}  # long sketches of the sets at hand
        group: dict[int, bytes] = {}  # those of the last least set, which may go on
        last = None

        def learn(t: pa.Table) -> pa.Table:
            """Keep the sketches of t and give its other rows."""
            nonlocal last, group, known
            known = dict(group)
            is_sketch = t.column("sketch").is_valid()
            for least, deal, doc, sketch in zip(*(t.filter(is_sketch).column(c).to_pylist() for c in ("least", "deal", "doc", "sketch")), strict=True):
                if (least, deal) != last:
                    last, group = (least, deal), {}
                known[doc] = group[doc] = sketch
            if (end := (t.column("least")[-1].as_py(), t.column("deal")[-1].as_py())) != last:
                last, group = end, {}
            return t.filter(t.column("sketch").is_null())

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= ROWS_AT_ONCE:
                t = pa.Table.from_batches(held)
                # Up to where the last signature begins: it may go on.
                sig, least = t.column("sig").to_numpy(), t.column("least").to_numpy()
                cut = np.flatnonzero((sig[1:] != sig[:-1]) | (least[1:] != least[:-1]))
                if len(cut):
                    yield from make(learn(t.slice(0, int(cut[-1]) + 1)), known)
                    rest = t.slice(int(cut[-1]) + 1)
                    held, size = rest.to_batches(), rest.num_rows
        if size:
            yield from make(learn(pa.Table.from_batches(held)), known)

    spark = rows.sparkSession
    each = rows.groupBy("least", "doc").agg(F.count("*").alias("_n"))
    large = each.groupBy("least").agg(F.count("*").alias("_docs"), F.sum("_n").alias("_rows")).filter((F.col("_docs") > MANY) | (F.col("_rows") > DEAL_ROWS))
    large = written(spark, large, "large")
    deals = F.least(F.lit(SPREAD).cast("long"), F.ceil(F.col("_rows") / DEAL_ROWS))
    placed = rows.join(large, "least", "left").withColumn("deal", F.coalesce(F.pmod("sig", deals), F.lit(0).cast("long")))
    placed = written(spark, placed.select("least", "deal", "sig", "doc", "comp", *_BOUNDS, (F.coalesce("_docs", F.lit(0)) > MANY).alias("_many")), "dealt")
    asked = placed.filter("_many").select("least", "deal", "doc").distinct().join(sketches, "doc")
    none = F.lit(0).cast("long")
    asked = asked.select("least", "deal", none.alias("sig"), "doc", none.alias("comp"), *[none.alias(c) for c in _BOUNDS], "sketch")
    both = placed.drop("_many").withColumn("sketch", F.lit(None).cast("binary")).unionByName(asked)
    dealt = both.repartition("least", "deal").sortWithinPartitions("least", "deal", F.col("sketch").isNull(), "sig", "comp", "doc")
    found = written(spark, arrow_map(dealt, run, "a long, b long").distinct(), "pairs")
    delete(spark, large, placed)
    return found


#: Bits of the map of hashed ids for each id, and of the whole map at most.
ID_BITS, MAP_BITS = 16, 1 << 28


def _of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the ids wanted (distinct, in a table that is written). A broadcast bitmap of hashed ids, two bytes an id, keeps most
    other texts out of the shuffle; the join decides."""
    bits = F.lit(min(max(ID_BITS * wanted.count(), 1 << 15), MAP_BITS)).cast("long")
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), bits)
    part, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    maps = wanted.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    likely = texts.withColumns({"_part": part, "_bit": bit}).join(F.broadcast(maps), "_part").withColumn("_byte", byte).filter("(shiftright(_byte, cast(_bit % 8 as int)) & 1) = 1")
    return likely.select(*texts.columns).join(wanted, "doc_id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, share: Fraction) -> DataFrame:
    """The pairs that link, by their whole texts: only those of documents in a pair are shuffled."""
    p, q = share.numerator, share.denominator
    spark = texts.sparkSession
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = written(spark, wanted, "wanted")
    texts = written(spark, _of(texts, wanted), "compared")
    pairs = written(spark, _near_counts(pairs, texts, k, share), "near")
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ok = [linked(x, y, p, q) for x, y in zip(sets_of(b.column("text_a"), k), sets_of(b.column("text_b"), k), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = written(spark, arrow_map(rows, run, "a long, b long"), "links")
    delete(spark, texts, pairs, wanted)
    return found


def _near_counts(pairs: DataFrame, texts: DataFrame, k: int, share: Fraction) -> DataFrame:
    """Pairs left open by counts of shingles in BUCKETS parts of the domain: sets differ by the sum of differences of their
    counts at least, which is a bound for sets of any size. A kilobyte a document is compared instead of its text."""
    p, q = share.numerator, share.denominator

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, counts = [], []
            for s in sets_of(column(b, "text"), k):
                n.append(len(s))
                counts.append(np.minimum(np.bincount((s >> _U(11)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(counts, pa.binary())], names=["doc_id", "n", "counts"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                va, vb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in ("ca", "cb"))
                apart = np.abs(va - vb).sum(1, dtype=np.int64)
                n = b.column("na").to_numpy() + b.column("nb").to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array((q + p) * apart <= (q - p) * n))

    v = arrow_map(texts, count, "doc_id long, n long, counts binary")
    rows = pairs.join(v.toDF("b", "nb", "cb"), "b").join(v.toDF("a", "na", "ca"), "a").select("a", "b", "na", "nb", "ca", "cb")
    return arrow_map(rows, near, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, share: Fraction = Fraction(4, 5), id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles (distinct k-word shingles), component_id (least id reachable by links) for every row.

    Two documents link when their shingle sets have a Jaccard similarity of `share` at least. With fewer than k words the
    whole sequence is the one shingle; null and empty texts have none, link with nothing and are components of their own.
    Where rows repeat an id with different texts, a link of any of them counts for the id. A null id has a null component and takes no
    part. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("text"))
    profiles = written(spark, _profiles(d, k), "profiles")
    usable = profiles.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = usable.groupBy("d0", "d1", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = written(spark, copies, "copies")
    texts = written(spark, d.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "texts")

    live, made = texts, []
    for turn in range(len(CONTENT)):
        parts = [written(spark, _signature_rows(live, k, share, turn, x), "rows") for x in range(SLICES)]
        rows = reduce(DataFrame.unionByName, parts)
        if turn == 0:
            star = rows.filter("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct()
            star = written(spark, star.join(_side(usable, "a"), "a").join(_side(usable, "b"), "b").filter(_open(share)).select("a", "b").distinct(), "star")
            links = _verified(star, texts, k, share)
            made += [star, links]
            comp = components(spark, links)
        # Signatures whose sets are not yet all in one component.
        placed = rows.join(comp, rows["doc"] == comp["node"], "left").select("sig", "doc", "n", "least", F.coalesce("component", "doc").alias("comp"))
        placed = written(spark, placed, "placed")
        last = turn == len(CONTENT) - 1
        few = F.lit(True) if last else F.col("n") <= LARGE
        apart = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("sig")
        apart = written(spark, placed.join(apart, "sig", "left_semi"), "apart")
        bounds = _side(usable, "a").withColumnRenamed("a", "doc")
        # Where rows repeat an id, its sets have no sketch and stay open.
        sketches = usable.groupBy(F.col("doc_id").alias("doc")).agg(F.count("*").alias("_n"), F.first("sketch").alias("sketch")).filter("_n = 1").select("doc", "sketch")
        pairs = _pairs(apart.filter(few).join(bounds, "doc").withColumnsRenamed({f"a_{c}": c for c in _BOUNDS}), sketches, share)
        more = _verified(pairs, live, k, share)
        links = links.unionByName(more)
        before, olds = live, [comp]
        comp = components(spark, links)
        if not last:
            again = written(spark, apart.filter(~few).select(F.col("doc").alias("doc_id")).distinct(), "again")
            live = written(spark, _of(live, again), "texts")
            made.append(again)
        delete(spark, *parts, placed, apart, pairs)
        made += [before, more, *olds]
        if last or live.isEmpty():
            made += [] if last else [live]
            break
    delete(spark, *made)

    out = profiles.select("doc_id", "n_shingles", "d0", "d1").join(reps, ["d0", "d1", "n_shingles"], "left")
    node = F.coalesce("rep", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, node).otherwise(F.col("doc_id")).alias("node"))
    return out.join(comp, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, share: Fraction = Fraction(4, 5), id_col: str = "doc_id") -> DataFrame:
    """One document of each component, with all its columns: that of least id, then of least text (null first). A document is
    an id and a text: rows that repeat an id with other texts are judged one by one, rows that agree in both are one. Rows
    without an id stay, and so do null and empty texts, which link with nothing. An empty table gives no rows."""
    own = {c: c if c in (id_col, "text") else f"_own{n}" for n, c in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    key = F.col(f"`{id_col}`")
    given, made = safe.filter(key.isNotNull()), []
    if given.groupBy(key).count().filter("count > 1").isEmpty():
        found = near_duplicates(given, k, share, id_col).filter("doc_id = component_id").select("doc_id")
    else:  # an id does not tell documents apart: rows are numbered, and a component's least document is looked for
        given = written(given.sparkSession, given.withColumn("_node", F.monotonically_increasing_id()), "numbered")
        made = [given]
        comp = near_duplicates(given.select("_node", "text"), k, share, "_node").filter("n_shingles > 0")
        linked = given.select(key.cast("long").alias("_id"), "text", "_node").join(comp.select(F.col("doc_id").alias("_node"), F.col("component_id").alias("_comp")), "_node", "left")
        order = F.struct("_id", F.col("text").isNotNull(), "text", "_node")
        alone = F.col("_comp").isNull()  # without a shingle: one of each id and text
        found = linked.groupBy("_comp", F.when(alone, F.col("_id")).alias("_k"), F.when(alone, F.col("text")).alias("_t")).agg(F.min(order)["_node"].alias("doc_id")).select("doc_id")
    node = F.col("_node") if made else key.cast("long")
    kept = given.join(found.select(F.col("doc_id").alias("_found")), node == F.col("_found"), "left_semi").drop("_node")
    return kept.unionByName(safe.filter(key.isNull())).select(*[F.col(f"`{x}`").alias(c) for c, x in own.items()])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; what near_duplicates says of nulls, empty, very long and repeated texts, ties and empty tables holds."""
    return near_duplicates(only(table(spark, sf_dir, "documents"), "doc_id", "text"), 4, Fraction(85, 100))
