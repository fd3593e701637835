"""Concordant and discordant pairs by counting inversions over ranges of both values.

Both values are cut into ranges at splitters; a value that is a splitter has a range of its own, so that a value which many
rows share is never joined to others. Pairs in different ranges of both follow from the counts of a grid of ranges by
prefix sums. Pairs in one range of x, and pairs in one range of y from different ranges of x, are counted inside that
range. No pair is made; what one task sees is a range, or the grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import arrow_groups, arrow_map, written
from .ordering import SAMPLED, below

#: Splitters of a value: the grid has at most (2 * SPLITTERS + 1) ** 2 cells.
SPLITTERS = 128


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w * w' over the pairs that x and y order alike, less that of those they order differently; ties of either count 0.

    Bit by bit of y's rank, from the highest: rows whose ranks agree in the bits before are together in the order of x, and a
    one before a zero is an inversion.
    """
    order = np.lexsort((y, x))
    x, w = x[order], w[order].astype(float)
    rank = np.unique(y[order], return_inverse=True)[1]
    total = 0.0
    at = np.arange(len(x))
    for bit in range(int(rank.max()).bit_length() - 1 if len(rank) else -1, -1, -1):
        group, one = rank[at] >> (bit + 1), (rank[at] >> bit) & 1
        weight = w[at]
        ones, zeros = np.cumsum(weight * one), np.cumsum(weight * (1 - one))
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(begin, len(group)))
        start = lambda sums: np.repeat(np.concatenate([[0.0], sums])[begin], size)  # noqa: E731, B023
        total += float((weight * np.where(one == 1, zeros - start(zeros), start(ones) - ones)).sum())
        at = at[np.lexsort((one, group))]  # stable
    # Rows of one x came with rising y, as if ordered alike.
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    same = np.add.reduceat(w, first) if len(first) else np.zeros(0)
    cell = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (rank[1:] != rank[:-1]))) if len(x) else np.zeros(0, np.int64)
    both = np.add.reduceat(w, cell) if len(cell) else np.zeros(0)
    return total - float((same * same).sum() - (both * both).sum()) / 2.0


def grid_concordance(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> float:
    """The same for pairs in different rows and columns of a grid of counts."""
    if not len(i):
        return 0.0
    g = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
    np.add.at(g, (i, j), n)
    upto = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    upto[1:, 1:] = g.cumsum(0).cumsum(1)
    low = upto[:-1, :-1]  # both smaller
    high = upto[:-1, -1:] - upto[:-1, 1:]  # smaller row, larger column
    return float((g * (low - high)).sum())


def _range(x: Column, splits: Sequence, kind: str) -> Column:
    """Even numbers between splitters, the odd one after for the splitter itself."""
    if not splits:
        return F.lit(0)
    held = F.array(*[F.lit(s).cast(kind) for s in splits])
    at = below(held, x, len(splits))
    return 2 * at + F.coalesce((F.get(held, at) == x).cast("int"), F.lit(0))


def kendall_sum(df: DataFrame, x: str, y: str, splitters: int = SPLITTERS) -> DataFrame:
    """One row: s (concordant less discordant pairs), n (pairs of values), tx, ty (pairs tied in x, in y). Rows without either value do not count."""
    kind = {c: df.schema[c].dataType.simpleString() for c in (x, y)}
    fine = F.lit(True)
    for c in (x, y):
        fine &= F.col(c).isNotNull() & (~F.isnan(c) if kind[c] in ("double", "float") else F.lit(True))
    cells = written(df.filter(fine).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("w")), "cells")
    # A bounded sample of the rows says where to cut; any cuts give the same result.
    sample = cells.orderBy(F.xxhash64("x", "y")).select("x", "y").limit(SAMPLED * splitters).collect()
    cut = lambda k: sorted(set(sorted(r[k] for r in sample)[SAMPLED - 1 :: SAMPLED] or {r[k] for r in sample[:1]}))
    heavy = lambda c: [r[0] for r in cells.groupBy(c).agg(F.sum("w").alias("w")).orderBy(F.desc("w"), c).limit(splitters // 2).collect()]
    cuts = {c: sorted({*cut(k), *heavy(c)}) for k, c in enumerate(("x", "y"))}
    p = cells.select("x", "y", "w", _range(F.col("x"), cuts["x"], kind[x]).alias("i"), _range(F.col("y"), cuts["y"], kind[y]).alias("j"))
    p = written(p, "ranges")

    def inside(t: pa.Table) -> pa.Table:
        ranked = [_dense(t.column(c)) for c in "uv"]
        return pa.table({"s": pa.array([concordance(*ranked, t.column("w").to_numpy())], pa.float64())})

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            yield pa.RecordBatch.from_arrays([pa.array([grid_concordance(*(t.column(c).to_numpy() for c in ("i", "j", "n")))], pa.float64())], names=["s"])

    rows = p.filter("i % 2 = 0").select(F.col("i").alias("at"), F.col("x").alias("u"), F.col("y").alias("v"), "w")  # one value of x has no pairs
    columns = p.filter("j % 2 = 0").groupBy(F.col("j").alias("at"), F.col("i").alias("u"), F.col("y").alias("v")).agg(F.sum("w").alias("w"))
    counts = p.groupBy("i", "j").agg(F.sum("w").alias("n")).repartition(1)  # at most (2 * splitters + 1) ** 2 rows, whatever the table
    s = arrow_groups(rows, ["at"], inside, "s double").unionAll(arrow_groups(columns, ["at"], inside, "s double")).unionAll(arrow_map(counts, grid, "s double"))
    tied = lambda c: cells.groupBy(c).agg(F.sum("w").cast("double").alias("w")).agg(F.sum(F.col("w") * (F.col("w") - 1) / 2.0).alias(f"t{c}"))
    n = cells.agg(F.sum("w").cast("double").alias("w")).select((F.col("w") * (F.col("w") - 1) / 2.0).alias("n"))
    return s.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).crossJoin(n).crossJoin(tied("x")).crossJoin(tied("y"))  # rows of one


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of the values, equal ones alike."""
    return np.asarray(pc.rank(column.combine_chunks(), tiebreaker="dense"))


def kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r: tau-b of every pair of columns; null where one of them is constant."""
    out = None
    for k, a in enumerate(columns):
        for b in columns[k:]:
            if a == b:
                row = df.agg(F.when(F.min(a) < F.max(a), 1.0).alias("r")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r")
                out = row if out is None else out.unionByName(row)
                continue
            one = kendall_sum(df.select(F.col(a).alias("x"), F.col(b).alias("y")), "x", "y")
            r = F.col("s") / F.nullif(F.sqrt(F.col("n") - F.col("tx")) * F.sqrt(F.col("n") - F.col("ty")), F.lit(0.0))
            row = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"))
            out = row if out is None else out.unionByName(row)
    return out
