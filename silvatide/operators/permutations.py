"""Permutation tests on pairwise distances: all permutations in one pass over tiles of squared distances.

A permutation is a function of a place: a Feistel network over the next power of four, walked along its cycle until it falls
below the number of samples. So any task can tell any sample's label in any permutation, and the draws are the same however
many samples and tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import arrow_map, written
from .ordering import with_places

_U = np.uint64
ROUNDS = 6
#: Places of a block, and permutations that are multiplied at a time.
BLOCK, STRIP = 1024, 256


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def permuted(places: np.ndarray, turns: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where permutation `turn` of range(n) puts a place, for places and turns of one shape. Turn 0 leaves all in place."""
    half = _U(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (_U(1) << half) - _U(1)
    keys = _scrambled(np.asarray(turns, np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed % (1 << 64)))
    at = np.asarray(places, np.uint64).copy().ravel()
    keys, moved = keys.ravel(), np.flatnonzero(np.asarray(turns).ravel() != 0)
    while len(moved):
        left, right = at[moved] >> half, at[moved] & mask
        for k in range(ROUNDS):
            left, right = right, left ^ (_scrambled(right * _U(0xD6E8FEB86659FD93) + keys[moved] + _U(k)) & mask)
        at[moved] = (left << half) | right
        moved = moved[at[moved] >= _U(n)]
    return at.reshape(np.shape(places)).astype(np.int64)


def within_sums(pairs: DataFrame, groups: DataFrame, sizes: Sequence[int], weights: Sequence[float], permutations: int, seed: int, block: int = BLOCK) -> DataFrame:
    """turn, within, total for turns 0 (the labels as they are) to `permutations`: sums of squared distances, those inside a group times its weight.

    groups: sample, place; places count through the groups of these sizes, one after another. The indicator matrix of each label (samples by
    permutations) is multiplied with blocks of squared distances; a partition sends one number for each permutation.
    """
    n, upto = int(sum(sizes)), np.cumsum(sizes)
    p = groups.select("sample", "place")
    placed = pairs.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b").select(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y"), (F.col("distance") * F.col("distance")).alias("d2"))
    key = [(F.col(c) / block).cast("long") for c in "xy"]
    tiles = placed.select(key[0].alias("i"), key[1].alias("j"), "x", "y", "d2").repartition("i", "j").sortWithinPartitions("i", "j")
    weight = np.asarray(weights, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.arange(permutations + 1)
        within, total, at, d = np.zeros(len(turns)), 0.0, None, None
        known: dict[int, np.ndarray] = {}

        def labels(b: int) -> np.ndarray:
            """Labels of a block's places in all permutations; of the blocks used last."""
            if b not in known:
                while len(known) > 3:
                    known.pop(next(iter(known)))
                places = np.arange(b * block, min(n, (b + 1) * block))
                grid = np.broadcast_arrays(places[:, None], turns[None, :])
                known[b] = np.searchsorted(upto, permuted(grid[0], grid[1], n, seed), "right").astype(np.int32)
            return known[b]

        def closed() -> None:
            left, right = labels(at[0]), labels(at[1])
            for s in range(0, len(turns), STRIP):
                l, r = left[:, s : s + STRIP], right[:, s : s + STRIP]
                for g in np.intersect1d(l, r):
                    if weight[g]:
                        within[s : s + STRIP] += weight[g] * ((d[: len(l), : len(r)] @ (r == g).astype(float)) * (l == g)).sum(0)

        for b in batches:
            i, j, x, y, d2 = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            cut = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0)) if len(i) else []
            for s, e in zip(cut, [*cut[1:], len(i)], strict=True):
                if (i[s], j[s]) != at:
                    if at is not None:
                        closed()
                    at, d = (int(i[s]), int(j[s])), np.zeros((block, block))
                np.add.at(d, (x[s:e] - at[0] * block, y[s:e] - at[1] * block), d2[s:e])
                total += float(d2[s:e].sum())
        if at is not None:
            closed()
            yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int64()), pa.array(within), pa.array(np.full(len(turns), total))], names=["turn", "within", "total"])

    return arrow_map(tiles, run, "turn bigint, within double, total double").groupBy("turn").agg(F.sum("within").alias("within"), F.sum("total").alias("total"))


#: Statistics that differ by less than this share count as equal: a sum's last digits depend on its order.
EQUAL = 1e-12


def permanova_p(pairs: DataFrame, groups: DataFrame, permutations: int = 999, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """f_statistic, p_value, permutations: the share of permutations of the labels with an F no smaller; NaN without permutations.

    One way for any number of samples; the observed labels are a permutation of the same pass. To the driver come the sizes of the groups.
    """
    spark = pairs.sparkSession
    g = written(groups.toDF("sample", "group"), "groups")
    sizes = [r.n for r in g.groupBy("group").agg(F.count("*").alias("n")).orderBy("group").collect()]  # a row a group
    n, k = sum(sizes), len(sizes)
    share = lambda m: 1.0 / m - 2.0 / (m * (m - 1)) if m > 1 else 0.0
    sums = within_sums(pairs, with_places(g, [F.col("group"), F.col("sample")]), sizes, [share(m) for m in sizes], permutations, seed, block)
    every = spark.range(permutations + 1).withColumnRenamed("id", "turn").join(sums, "turn", "left").na.fill(0.0)
    between = F.lit(share(n)) * F.col("total") - F.col("within")
    f = F.when((F.col("within") > 0) & F.lit(n > k > 1), (between / max(k - 1, 1)) / F.nullif(F.col("within") / max(n - k, 1), F.lit(0.0))).otherwise(0.0)
    one = every.select("turn", f.alias("f")).agg(F.max(F.when(F.col("turn") == 0, F.col("f"))).alias("f_statistic"), F.collect_list(F.when(F.col("turn") > 0, F.col("f"))).alias("fs"))  # a number a permutation
    hits = F.size(F.filter("fs", lambda x: x >= F.col("f_statistic") - F.abs("f_statistic") * EQUAL))
    p = hits / F.lit(float(permutations)) if permutations else F.lit(float("nan"))
    return one.select("f_statistic", p.alias("p_value"), F.lit(permutations).alias("permutations"))
