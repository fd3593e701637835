"""Values for every pair of samples, tile by tile.

Samples are dealt to blocks by hash; a tile is a pair of blocks. Each block goes to its tiles in one shuffle, and a tile's
pairs come from array operations over the features that both blocks have: common ones are counted by AND and popcount of
packed bitmaps, products and minima are taken of dense rows. Nothing is joined on a feature, which most samples may
share; a block's bytes are shuffled once for each other block, BLOCK times less than there are pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import arrow_groups, arrow_map, written

#: Samples of a block, about: of bitmaps, and of blocks that hold numbers.
BLOCK, DENSE_BLOCK = 1024, 256
#: Blocks of bitmaps grow up to so many samples and bytes while so many tiles are left: a block is shuffled once for each other block.
MOST_BLOCK, BLOCK_BYTES, LEAST_TILES = 16384, 1 << 20, 1024
#: Tiles of a task, where there are many; grown blocks count as the tiles that they take the place of.
TASK_TILES = 64
#: Pairs of an Arrow batch, about.
BATCH_PAIRS = 1 << 18

Strips = Iterator[tuple[int, np.ndarray]]


def _rows(samples: DataFrame, cells: DataFrame, features: DataFrame, valued: bool) -> DataFrame:
    """sample, c: the features (by their number f, in no order) and values of each sample, an empty array for one without any; each cell once."""
    one = F.struct("f", (F.col("v") if valued else F.lit(1.0)).alias("v"))
    rows = cells.join(features, "feature").groupBy("sample").agg(F.collect_set(one).alias("c"))  # a sample's features: columns of the table
    return samples.select("sample").distinct().join(rows, "sample", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<f:bigint,v:double>>")))


def _packed(rows: DataFrame, blocks: int, pack: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], parts: int) -> DataFrame:
    """block, samples, and the `parts` binary columns that pack(row of each cell and row count, features, values) makes of a block's rows."""
    kind = rows.schema["sample"].dataType.simpleString()
    schema = f"block bigint, samples array<{kind}>, {', '.join(f'd{k} binary' for k in range(parts))}"

    def run(t: pa.Table) -> pa.Table:
        c = t.column("c").combine_chunks()
        flat, ends = c.flatten(), np.asarray(c.offsets)[1:] - np.asarray(c.offsets)[0]
        made = pack(ends.astype(np.int64), np.asarray(flat.field("f")), np.asarray(flat.field("v")))
        samples = t.column("sample").combine_chunks()
        listed = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), samples)
        names = ["block", "samples", *[f"d{k}" for k in range(parts)]]
        return pa.table([t.column("block").combine_chunks()[:1], listed, *[pa.array([m.tobytes()], pa.binary()) for m in made]], names=names)

    return arrow_groups(rows.withColumn("block", F.pmod(F.xxhash64("sample"), F.lit(blocks))), ["block"], run, schema)


def _grown(samples: int, features: int, block: int, least_tiles: int) -> int:
    """Samples of a block of bitmaps: `block`, doubled while a block stays small and tiles enough are left."""
    while (more := 2 * block) <= MOST_BLOCK and more * (features // 8 + 16) <= BLOCK_BYTES and (n := -(-samples // more)) * (n + 1) // 2 >= least_tiles:
        block = more
    return block


def _tiled(samples: DataFrame, cells: DataFrame, valued: bool, block: int, pack: Callable, parts: int, strips: Callable[[list[np.ndarray], list[np.ndarray], int], Strips]) -> DataFrame:
    """a, b, distance of every pair a < b of different samples. strips(left, right, rows) gives a tile some rows at a time: the first row, and the matrix of them by all columns."""
    cores = samples.sparkSession.sparkContext.defaultParallelism
    held = written(cells, "cells")
    features = written(held.select("feature").distinct().withColumn("f", F.monotonically_increasing_id()), "features")
    there, least = samples.select("sample").distinct().count(), block
    block = block if valued else _grown(there, features.count(), block, max(LEAST_TILES, 3 * cores))
    n = max(1, -(-there // block))
    b = written(_packed(_rows(samples, held, features, valued), n, pack, parts), "blocks")
    data = [c for c in b.columns if c.startswith("d")]
    kind = b.schema["samples"].dataType.elementType.simpleString()
    side = lambda i, j, k: b.select(i.alias("i"), j.alias("j"), *[F.col(c).alias(f"{k}_{c}") for c in ("samples", *data)])
    left = side(F.col("block"), F.explode(F.sequence(F.col("block"), F.lit(n - 1).cast("long"))), "l")
    right = side(F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))), F.col("block"), "r")
    # Tiles are few bytes and much work, so their number and not their size says how many tasks there are.
    count = n * (n + 1) // 2
    tasks = max(1, min(count, max(3 * cores, count // max(1, TASK_TILES * least**2 // block**2))))
    # The planner takes a side for no larger than the blocks, of which each is there n times, and would send all of it to the driver.
    tiles = left.hint("merge").join(right, ["i", "j"]).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                of = lambda name, row=row, batch=batch: batch.column(at[name])[row]
                same = of("i").as_py() == of("j").as_py()
                both = pa.concat_arrays([of("l_samples").values, of("r_samples").values])
                x, y = ([np.frombuffer(of(f"{k}_{c}").as_buffer(), np.uint8) for c in data] for k in "lr")
                split = len(of("l_samples").values)
                rank = np.empty(len(both), np.int64)
                rank[np.asarray(pc.sort_indices(both))] = np.arange(len(both))
                rank_x, rank_y = rank[:split], rank[split:]
                for first, d in strips(x, y, max(1, BATCH_PAIRS // max(len(rank_y), 1))):
                    if same:  # of a block with itself each pair once
                        r, c = np.nonzero(np.arange(d.shape[1])[None, :] > (first + np.arange(len(d)))[:, None])
                        values = d[r, c]
                    else:
                        r, c = np.repeat(np.arange(len(d)), d.shape[1]), np.tile(np.arange(d.shape[1]), len(d))
                        values = d.ravel()
                    if len(r):
                        turned = rank_x[first + r] > rank_y[c]
                        l, r = first + r, c + split
                        a, b = np.where(turned, r, l), np.where(turned, l, r)
                        yield pa.RecordBatch.from_arrays([pc.take(both, pa.array(a)), pc.take(both, pa.array(b)), pa.array(values, pa.float64())], names=["a", "b", "distance"])

    return arrow_map(tiles, run, f"a {kind}, b {kind}, distance double")


# Bitmaps.
def _bitmaps(ends: np.ndarray, f: np.ndarray, _: np.ndarray) -> list[np.ndarray]:
    """Number of rows and the block's features, and the packed bits of each row over them."""
    features, at = np.unique(f, return_inverse=True)
    on = np.zeros((len(ends), len(features)), bool)
    on[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), at] = True
    return [np.append(len(ends), features).astype("<i8"), np.packbits(on, axis=1)]


class Bits:
    def __init__(self, head: np.ndarray, bits: np.ndarray):
        head = head.view("<i8")
        self.features = head[1:]
        self.bits = bits.reshape(int(head[0]), -1)
        self.sizes = np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def words(self, features: np.ndarray) -> np.ndarray:
        """The bits of these features in 64-bit words, a line of words for all rows."""
        out = np.zeros((len(self.bits), -(-len(features) // 64) * 8), np.uint8)
        if len(features):
            picked = np.unpackbits(self.bits, axis=1, count=len(self.features))[:, np.searchsorted(self.features, features)]
            out[:, : -(-len(features) // 8)] = np.packbits(picked, axis=1)
        return np.ascontiguousarray(out.view(np.uint64).T)


def presence_pairs(samples: DataFrame, present: DataFrame, distance: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """a, b, distance(common, na, nb) for all samples; present: sample, feature. common is a matrix, na a column and nb a row."""

    def strips(left: list[np.ndarray], right: list[np.ndarray], rows: int) -> Strips:
        x, y = Bits(*left), Bits(*right)
        features = np.intersect1d(x.features, y.features)
        u, v = x.words(features), y.words(features)
        for s in range(0, len(x.sizes), rows):
            common = np.zeros((len(x.sizes[s : s + rows]), len(y.sizes)), np.int64)
            for p, q in zip(u, v, strict=True):
                common += np.bitwise_count(p[s : s + rows, None] & q[None, :])
            yield s, distance(common, x.sizes[s : s + rows, None], y.sizes[None, :])

    return _tiled(samples, present, False, BLOCK, _bitmaps, 2, strips)


# Numbers.
def _sparse(ends: np.ndarray, f: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    return [ends.astype("<i8"), f.astype("<i8"), v.astype("<f8")]


class Rows:
    """The rows of a block: sums over all their features, and dense values of some."""

    def __init__(self, ends: np.ndarray, f: np.ndarray, v: np.ndarray):
        self.ends, self.f, self.v = ends.view("<i8"), f.view("<i8"), v.view("<f8")
        self.row = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def total(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, of, len(self.ends))

    def dense(self, features: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(features, self.f), len(features) - 1)
        hit = np.flatnonzero(features[at] == self.f)
        out = np.zeros((len(self.ends), len(features)))
        out[self.row[hit], at[hit]] = self.v[hit]
        return out


#: Common features that are dense at a time.
CHUNK = 2048


def value_pairs(samples: DataFrame, cells: DataFrame, distance: Callable[[Rows, Rows, Callable], np.ndarray]) -> DataFrame:
    """a, b, distance for all samples; cells: sample, feature, v (not 0), each pair once. distance(x, y, over) gets the rows of both blocks, and
    over(g), which sums g(dense x, dense y) over the features that both have."""

    def strips(left: list[np.ndarray], right: list[np.ndarray], rows: int) -> Strips:
        x, y = Rows(*left), Rows(*right)
        common = np.intersect1d(x.f, y.f)

        def over(g: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            out = np.zeros((len(x.ends), len(y.ends)))
            for k in range(0, len(common), CHUNK):
                out += g(x.dense(common[k : k + CHUNK]), y.dense(common[k : k + CHUNK]))
            return out

        d = distance(x, y, over)
        for s in range(0, len(d), rows):
            yield s, d[s : s + rows]

    return _tiled(samples, cells, True, DENSE_BLOCK, _sparse, 3, strips)


def least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of minima of each row of x with each row of y."""
    return np.stack([np.minimum(row, y).sum(1) for row in x]) if len(x) else np.zeros((0, len(y)))
