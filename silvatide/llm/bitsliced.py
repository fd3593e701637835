"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to floor(256 * x). A block of them is stored by bits: one
bitmap for each bit of each component, counted from the component's least value.
The scores of all rows of a block for a query are added up as bit slices:
wherever a bit of the query's component is set, the component's slices are added
with bitmap logic at that offset. The top rows are then chosen from the most
significant slice downward, and rows that tie at the boundary are resolved by id.

Slices are made once, when the index is built, and written. Every block of
queries meets every block of rows: both are dealt to their pairs in one shuffle,
in which a row travels once for each block of queries and a query once for each
block of rows. In a task a small group of queries is worked on together: a bitmap
operation covers (queries x rows of the block) bits, with the query's bit as a mask.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import arrow_map, table, written
from .textops import column

_U = np.uint64
#: Rows of a data block, queries of a query block, and queries worked on at once.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 16384, 4096, 128
K, SCALE, QUERY_STEP = 5, 256, 50
#: From this bound on sums are kept in Python's integers, which have no limit.
WIDE = 1 << 62


class BitSliced:
    """slices[c][b] is the bitmap of bit b of v - low for component c, where low is the component's least value in the block."""

    def __init__(self, values: np.ndarray):
        self.n, self.dim = values.shape
        self.words = (self.n + 63) // 64
        # An offset for each component makes values non-negative; it is put back as a constant of the query.
        self.low = values.min(0)
        shifted = values.view(np.uint64) - self.low.view(np.uint64)  # wraps to the true difference, which fits
        self.width = [int(x).bit_length() for x in shifted.max(0)]
        self.slices = [[self._pack((shifted[:, c] >> _U(b)) & _U(1)) for b in range(self.width[c])] for c in range(self.dim)]

    def dump(self) -> bytes:
        """Rows and components as 64-bit integers, least values and widths of the components, then their slices."""
        flat = [s for c in self.slices for s in c]
        return struct.pack("<QQ", self.n, self.dim) + self.low.astype("<i8").tobytes() + np.array(self.width, "<i8").tobytes() + b"".join(s.tobytes() for s in flat)

    @staticmethod
    def load(raw: bytes) -> BitSliced:
        x = object.__new__(BitSliced)
        x.n, x.dim = struct.unpack_from("<QQ", raw)
        x.words = (x.n + 63) // 64
        x.low = np.frombuffer(raw, "<i8", x.dim, 16)
        x.width = np.frombuffer(raw, "<i8", x.dim, 16 + 8 * x.dim).tolist()
        flat = np.frombuffer(raw, "<u8", sum(x.width) * x.words, 16 + 16 * x.dim).reshape(-1, x.words)
        cut = np.concatenate([[0], np.cumsum(x.width)]).astype(int)
        x.slices = [list(flat[cut[c] : cut[c + 1]]) for c in range(x.dim)]
        return x

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        raw = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits.astype(bool), bitorder="little")
        raw[: len(packed)] = packed
        return raw.view(np.uint64)

    def scores(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Bit slices (each queries x words) of a non-negative sum, and what to add to get each query's true scores.

        A negative component of a query counts from the component's top instead: with top - (v - low) for v - low, which
        inverts its bits, the query's absolute value is added up.
        """
        n_q = len(queries)
        zero = np.zeros((n_q, self.words), np.uint64)
        full = ~np.zeros((1, 1), np.uint64)
        acc: list[np.ndarray] = []
        most = [max(abs(int(x)), abs(int(x) + (1 << w))) for x, w in zip(self.low, self.width, strict=True)]
        wide = sum(m * max(abs(int(queries[:, c].min())), abs(int(queries[:, c].max()))) for c, m in enumerate(most)) >= WIDE if n_q else False
        base = np.zeros(n_q, object if wide else np.int64)
        for c in range(self.dim):
            q = queries[:, c].astype(object) if wide else queries[:, c]
            w = self.width[c]
            if not w:
                base += q * int(self.low[c])
                continue
            top = (1 << w) - 1
            negative = queries[:, c] < 0
            base += np.where(negative, q * (int(self.low[c]) + top), q * int(self.low[c]))
            size = np.where(negative, (~queries[:, c]).view(np.uint64) + _U(1), queries[:, c].view(np.uint64))
            flip = np.where(negative, full[0, 0], _U(0))[:, None]
            part = [s[None, :] ^ flip for s in self.slices[c]]  # ~bits of v is the bits of top - v
            for b in range(int(size.max()).bit_length()):
                mask = np.where((size >> _U(b)) & _U(1) != 0, full[0, 0], _U(0))[:, None]
                if not mask.any():
                    continue
                carry = None
                k = b
                for s in part:
                    x = s & mask
                    while len(acc) <= k:
                        acc.append(zero.copy())
                    a = acc[k]
                    half = a ^ x
                    if carry is None:
                        carry = a & x
                        acc[k] = half
                    else:
                        acc[k] = half ^ carry
                        carry = (a & x) | (half & carry)
                    k += 1
                while carry is not None and carry.any():
                    while len(acc) <= k:
                        acc.append(zero.copy())
                    acc[k], carry = acc[k] ^ carry, acc[k] & carry
                    k += 1
        return acc, base

    def top(self, queries: np.ndarray, k: int, own: np.ndarray, own_rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its k best rows and those that tie with the last: (query, rows, scores). own and own_rows: pairs of a query and a row that it must not get."""
        acc, base = self.scores(queries)
        n_q = len(queries)
        valid = np.zeros(self.words * 64, bool)
        valid[: self.n] = True
        equal = np.repeat(np.packbits(valid, bitorder="little").view(np.uint64)[None, :], n_q, 0)
        np.bitwise_and.at(equal, (own, own_rows >> 6), ~(_U(1) << (own_rows & 63).astype(np.uint64)))
        sure = np.zeros_like(equal)
        for s in reversed(acc):
            x = sure | (equal & s)
            many = (np.bitwise_count(x).sum(1) >= k)[:, None]
            sure = np.where(many, sure, x)
            equal = equal & np.where(many, s, ~s)
        for q in range(n_q):
            rows = np.flatnonzero(np.unpackbits((sure[q] | equal[q]).view(np.uint8), bitorder="little"))
            score = np.full(len(rows), base[q], base.dtype)
            for b, s in enumerate(acc):
                bit = (s[q, rows >> 6] >> (rows & 63).astype(np.uint64)) & _U(1)
                score += bit.astype(base.dtype) * (1 << b) if base.dtype == object else bit.astype(np.int64) << b
            yield q, rows, score


def quantised(vec: F.Column) -> F.Column:
    """floor(256 * x) of each component, as double; null unless every component is finite. One that no long can hold is an error."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    fits = lambda x: F.abs(x.cast("double") * SCALE) < 2.0**63
    return F.when(vec.isNotNull() & ok, F.transform(vec, lambda x: F.when(fits(x), scaled(x).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit the index")).cast("long"))))


def _blocks(df: DataFrame, rows: int, id_col: str, sliced: bool) -> DataFrame:
    """Rows packed to blocks (dim, ids and values as little-endian int64 bytes; with `sliced` the values as an index, in order of
    their ids); vectors of different lengths never share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([i for i, _ in held[dim]])
            vs = np.concatenate([v for _, v in held[dim]])
            at = 0
            while len(ids) - at >= rows or (whole and at < len(ids)):
                i, v = ids[at : at + rows], vs[at : at + rows]
                if sliced:
                    order = np.argsort(i, kind="stable")
                    i, v = i[order], np.ascontiguousarray(v[order])
                body = BitSliced(v).dump() if sliced else v.astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([i.astype("<i8").tobytes()], pa.binary()), pa.array([body], pa.binary())], names=["dim", "ids", "body"])
                at += rows
            held[dim] = [(ids[at:], vs[at:])]

        for b in batches:
            ids, v = column(b, "id").to_numpy(zero_copy_only=False), column(b, "v")
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, cut = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                at = (cut[own] - dim)[:, None] + np.arange(dim)
                held.setdefault(dim, []).append((ids[own], flat[at]))
                if sum(len(i) for i, _ in held[dim]) >= rows:
                    yield from out(dim, False)
        for dim in list(held):
            yield from out(dim, True)

    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return arrow_map(picked, run, "dim long, ids binary, body binary")


def top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row whose id is divisible by `step`, without itself.

    Ties go to the smaller id. Vectors that are null or hold a null or non-finite component, and null ids, take no part;
    only vectors of equal length are compared; fewer candidates give fewer rows. Of rows that repeat an id each takes part,
    and none is a candidate of its own id. An empty table gives no rows; other columns are ignored. A component beyond
    2 ** 55, or a score among the best that no long can hold, is an error.

    Each pair of a block of queries and a block of rows is met once, as the query set against all rows demands.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{id_col}`"), quantised(F.col(f"`{vec_col}`")).alias("v"))
    index = written(spark, _blocks(v, block_rows, id_col, True).withColumn("block", F.monotonically_increasing_id()), "bitsliced")
    queries = written(spark, _blocks(v.filter(F.col(f"`{id_col}`") % step == 0), block_queries, id_col, False).withColumn("group", F.monotonically_increasing_id()), "queries")
    # Two numbers for each block, however long its rows are.
    sides = [x.groupBy("dim").agg(F.collect_list(c).alias("others")) for x, c in ((index, "block"), (queries, "group"))]
    each = lambda x, mine, others, theirs: x.join(F.broadcast(others), "dim").withColumn(theirs, F.explode("others")).select("block", "group", F.lit(mine == "group").alias("asks"), "dim", "ids", "body")
    met = each(index, "block", sides[1], "group").unionByName(each(queries, "group", sides[0], "block"))
    n = index.count() * queries.count()
    tasks = max(1, min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = met.repartition(tasks, "block", "group").sortWithinPartitions("block", "group", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = None, None
        for b in batches:
            for i in range(b.num_rows):
                dim, own, raw = b.column("dim")[i].as_py(), np.frombuffer(b.column("ids")[i].as_py(), "<i8"), b.column("body")[i].as_py()
                if not b.column("asks")[i].as_py():
                    ids, data = own, BitSliced.load(raw)
                    continue
                values = np.frombuffer(raw, "<i8").reshape(len(own), dim)
                for at in range(0, len(own), AT_ONCE):
                    yield _search(ids, data, own[at : at + AT_ONCE], values[at : at + AT_ONCE], k)

    best = arrow_map(met, run, "query_id long, vec_id long, score long")
    # Each pair of blocks gives k rows a query, so the last choice is over k * blocks rows of a query, cut down on the map side.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(ids: np.ndarray, index: BitSliced, q_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    lo, hi = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    own = np.repeat(np.arange(len(q_ids)), hi - lo)
    rows_of = np.arange(len(own)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    out_q, out_v, out_s = [], [], []
    for q, rows, score in index.top(queries, k, own, rows_of):
        first = np.lexsort((ids[rows], -score))[:k] if score.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-score[i], ids[rows[i]]))[:k], np.int64)
        out_q.append(np.full(len(first), q_ids[q]))
        out_v.append(ids[rows[first]])
        out_s.append(score[first])
    cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return pa.RecordBatch.from_arrays([cat(out_q), cat(out_v), cat(out_s)], names=["query_id", "vec_id", "score"])


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings; what top_k says of nulls, numbers that are not finite, ties, repeated rows and empty tables holds."""
    return top_k(table(spark, sf_dir, "embeddings")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
