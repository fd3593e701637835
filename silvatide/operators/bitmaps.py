"""Sets of samples: bitmaps that are merged up a hierarchy, and posting lists in bounded blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .ordering import with_places

#: Places of a block of a posting list.
BLOCK = 4096


def rolled_up(rows: DataFrame, levels: Sequence[str], item: str, value: str) -> DataFrame:
    """levels (null below a row's own), samples (distinct items) and mean of `value`, of each path of levels and of its parents, without a total.

    Items are numbered; a path's items are bitmaps of 32,768 numbers, counted by the bits. The lowest level is made from the rows, which are read
    once; each parent ors the bitmaps of its children, so that no row is repeated for each level, and no set is built of items themselves.
    """
    d = written(rows.select(*levels, F.col(item).alias("_item"), F.col(value).alias("_v")), "rows")
    numbers = written(d.select("_item").distinct().withColumn("_id", F.monotonically_increasing_id()), "numbers")
    d = d.join(numbers, "_item", "left").withColumn("_bucket", F.bitmap_bucket_number("_id"))
    node = d.groupBy(*levels, "_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("_bits"), F.sum("_v").alias("_sum"), F.count("_v").alias("_n"))
    node, out = written(node, "paths"), None
    for k in range(len(levels), 0, -1):
        keys = list(levels[:k])
        if k < len(levels):
            node = node.groupBy(*keys, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
        one = node.groupBy(*keys).agg(F.sum(F.when(F.col("_bucket").isNotNull(), F.bitmap_count("_bits")).otherwise(0)).alias("samples"), (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"))
        one = one.select(*keys, *[F.lit(None).cast("string").alias(c) for c in levels[k:]], "samples", "mean")
        out = one if out is None else out.unionByName(one)
    return out


def sample_places(long: DataFrame) -> DataFrame:
    """sample, place: the samples with a value, numbered in order."""
    return written(with_places(long.filter("v > 0").select("sample").distinct(), [F.col("sample")], "place"), "samples")


def postings(long: DataFrame, samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """genome, block, n, offsets: the samples (by place) that hold each genome, as offsets from the start of blocks of `block` places, rising.

    A row has `block` offsets of two bytes at most, however many samples hold a genome.
    """
    if not 1 <= block <= 1 << 15:
        raise ValueError("a block has 1 to 32768 places")
    p = long.filter("v > 0").select("sample", "genome").distinct().join(samples, "sample")
    at = F.floor(F.col("place") / block).cast("long")
    lists = p.groupBy("genome", at.alias("block")).agg(F.array_sort(F.collect_list((F.col("place") % block).cast("smallint"))).alias("offsets"))
    return lists.select("genome", "block", F.size("offsets").alias("n"), "offsets")


def listed(lists: DataFrame, samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """genome, sample: the posting lists read back."""
    at = lists.select("genome", "block", F.explode("offsets").alias("offset")).select("genome", (F.col("block") * block + F.col("offset")).alias("place"))
    return at.join(samples, "place").select("genome", "sample")


def both(lists: DataFrame, a: str, b: str) -> DataFrame:
    """One row, n: how many samples hold both genomes, by intersecting blocks."""
    l, r = (lists.filter(F.col("genome") == g).select("block", F.col("offsets").alias(k)) for g, k in ((a, "l"), (b, "r")))
    return l.join(r, "block").agg(F.coalesce(F.sum(F.size(F.array_intersect("l", "r"))), F.lit(0)).alias("n"))
