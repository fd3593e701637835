"""Operators on the long containment table: sample, genome, v (absent cells count as 0)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import postings, sample_places
from .ordering import with_places
from .pairs import presence_pairs


def build(rows: DataFrame, sample: str = "sample", genome: str = "genome", value: str = "v") -> DataFrame:
    """The canonical long table: the maximum of each cell."""
    return rows.groupBy(F.col(sample).alias("sample"), F.col(genome).alias("genome")).agg(F.max(value).alias("v"))


def wide(long: DataFrame, genomes: Sequence[str]) -> DataFrame:
    """One column a genome (given, so that no job looks for them), absent cells 0, the row maximum and where it lies, largest first."""
    w = long.groupBy("sample").pivot("genome", list(genomes)).max("v").na.fill(0.0)
    cells = [F.struct(-F.col(f"`{g}`"), F.lit(k), F.lit(g).alias("g")) for k, g in enumerate(genomes)]
    best = F.array_min(F.array(*cells))["g"]
    top = F.greatest(*[F.col(f"`{g}`") for g in genomes]) if len(genomes) > 1 else F.col(f"`{genomes[0]}`")
    return w.withColumns({"max_containment": top, "max_containment_annotation": best}).orderBy(F.desc("max_containment"), "sample")


def to_long(w: DataFrame, sample: str = "sample", skip: Sequence[str] = ("max_containment", "max_containment_annotation")) -> DataFrame:
    """Every column but the sample and the two known ones is a genome; there must be one."""
    genomes = genome_columns(w, (sample, *skip))
    return w.unpivot([sample], [f"`{g}`" for g in genomes], "genome", "v").withColumnRenamed(sample, "sample")


def genome_columns(w: DataFrame, skip: Sequence[str] = ("max_containment", "max_containment_annotation")) -> list[str]:
    found = [c for c in w.columns if c not in skip]
    if not found:
        raise ValueError("the table has no genome column")
    return found


def row_max(long: DataFrame, ordinal: Column | None = None) -> DataFrame:
    """max_containment of each sample, and the first genome (by `ordinal`, else by name) that attains it."""
    order = F.col("genome") if ordinal is None else ordinal
    best = F.min_by("genome", F.struct(-F.col("v"), order))
    return long.groupBy("sample").agg(F.max("v").alias("max_containment"), best.alias("max_containment_annotation"))


def threshold_histogram(maxima: DataFrame, step: float, value: str = "max_containment") -> DataFrame:
    """For i = int(1 / step) down to 0: threshold (rounded to 2 digits), raw (i * step), and how many values are above raw.

    One pass: a value's number of thresholds below it is a position in the list of thresholds, so values are counted by
    position and counts summed from the top; nothing is compared pairwise.
    """
    if not 0.001 <= step <= 1:
        raise ValueError("step must lie in [0.001, 1]")
    n = int(1 / step)
    spark = maxima.sparkSession
    raw = [i * step for i in range(n + 1)]
    below = F.size(F.filter(F.array(*[F.lit(x) for x in raw]), lambda t: t < F.col(value))).alias("below")
    counts = maxima.select(below).groupBy("below").agg(F.count("*").alias("n"))
    marks = spark.createDataFrame([(i, round(x, 2), x) for i, x in enumerate(raw)], "i int, threshold double, raw double")
    joined = marks.join(F.broadcast(counts), F.col("below") > F.col("i"), "left")  # both sides hold one row a threshold at most
    return joined.groupBy("i", "threshold", "raw").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).drop("i").orderBy(F.desc("raw"))


def genome_to_samples(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The posting lists of the genomes (genome, block, n, offsets) and the samples that they number (sample, place): see bitmaps. listed() reads them back."""
    samples = sample_places(long)
    return postings(long, samples), samples


def sample_to_genomes(long: DataFrame) -> DataFrame:
    return long.filter("v > 0").groupBy("sample").agg(F.array_sort(F.collect_set("genome")).alias("genomes"))


def above(long: DataFrame, threshold: float = 0.5, genome: str | None = None) -> DataFrame:
    """Samples whose maximum, or whose value for one genome, is above the threshold. A genome that no cell has is an error."""
    if genome is not None:
        if long.filter(F.col("genome") == genome).isEmpty():
            raise ValueError(f"no genome {genome}")
        return long.filter((F.col("genome") == genome) & (F.col("v") > threshold)).select("sample", "v")
    return row_max(long).filter(F.col("max_containment") > threshold)


def select_samples(long: DataFrame, genome: str, threshold: float = 0.1) -> DataFrame:
    """Samples that reach the threshold for a genome; values that are no numbers never do."""
    return long.filter((F.col("genome") == genome) & (F.col("v").try_cast("double") >= threshold)).select("sample")


def accessions_above(rows: DataFrame, threshold: float = 0.0, acc: str = "acc", value: str = "containment") -> DataFrame:
    """Distinct accessions, of rows above the threshold if it is above 0."""
    kept = rows.filter(F.col(value) > threshold) if threshold > 0 else rows
    return kept.select(acc).distinct()


def presence(long: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The present cells alone."""
    return long.filter(F.col("v") > threshold).select("sample", "genome")


def threshold_to_zero(long: DataFrame, threshold: float = 0.0) -> DataFrame:
    return long.withColumn("v", F.when(F.col("v") > threshold, F.col("v")).otherwise(0.0))


def cooccurrence(long: DataFrame, threshold: float = 0.5, min_samples: int = 5) -> DataFrame:
    """For every pair of frequent genomes the number of samples that hold both; the diagonal is a genome's own count.

    The self-join runs over present cells only, on sample, after infrequent genomes are gone; a sample has at most as
    many cells as there are genomes. Zero pairs come from the (small) list of frequent genomes.
    """
    p = presence(long, threshold)
    frequent = p.groupBy("genome").agg(F.count("*").alias("n")).filter(F.col("n") >= min_samples).select("genome")
    p = p.join(frequent, "genome")
    both = p.toDF("genome_a", "sample").join(p.toDF("genome_b", "sample"), "sample").groupBy("genome_a", "genome_b").agg(F.count("*").alias("n"))
    names = frequent.agg(F.collect_list("genome").alias("g"))  # one genome name a row of the (bounded) genome dimension
    grid = names.select(F.explode("g").alias("genome_a"), "g").select("genome_a", F.explode("g").alias("genome_b"))
    return grid.join(both, ["genome_a", "genome_b"], "left").select("genome_a", "genome_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def presence_distance(long: DataFrame, threshold: float = 0.1, method: str = "jaccard", samples: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """a < b and their distance by presence, rounded to `digits`, if given. Pairs without a common genome are at 1, as are two empty samples. Tiles of
    packed bitmaps: see pairs."""
    if method not in _FROM_COUNTS:
        raise ValueError(f"unknown method {method}")
    ids = long if samples is None else samples
    p = presence(long, threshold).withColumnRenamed("genome", "feature")
    exact = _FROM_COUNTS[method]
    return presence_pairs(ids, p, exact if digits is None else lambda i, na, nb: np.round(exact(i, na, nb), digits))


def _jaccard(i: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    union = na + nb - i
    return np.where(union == 0, 1.0, 1.0 - i / np.maximum(union, 1))


def _dice(i: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return np.where(na + nb == 0, 1.0, 1.0 - 2.0 * i / np.maximum(na + nb, 1))


def _cosine(i: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return np.where((na == 0) | (nb == 0), 1.0, 1.0 - i / np.sqrt(np.maximum(na.astype(float) * nb, 1.0)))


_FROM_COUNTS = {"jaccard": _jaccard, "dice": _dice, "cosine": _cosine}


def mirrored(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """All cells of the square matrix: both orders, and 0 on the diagonal."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    same = ids.select(F.col("sample").alias("a"), F.col("sample").alias("b"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(back).unionByName(same)


def top_correlated_genomes(long: DataFrame, threshold: float, limit: int = 20) -> DataFrame:
    """Genomes by the number of samples above the threshold."""
    return long.filter(F.col("v") > threshold).groupBy("genome").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genome").limit(limit)


def report_summary(long: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Samples, samples above the threshold, and genomes."""
    m = row_max(long).agg(F.count("*").alias("samples"), F.count_if(F.col("max_containment") > threshold).alias("above"))
    return m.crossJoin(long.agg(F.count_distinct("genome").alias("genomes")))  # one row by one row


def top_samples(maxima: DataFrame, limit: int = 10, value: str = "max_containment") -> DataFrame:
    """The samples of the largest values."""
    return maxima.orderBy(F.desc(value), "sample").limit(limit)


def heatmap_cells(long: DataFrame, threshold: float | None = None) -> DataFrame:
    """The cells of a heatmap: values, or (with a threshold) 1 where a value is above it, else 0."""
    return long if threshold is None else long.withColumn("v", (F.col("v") > threshold).cast("int"))


def rank_plot(maxima: DataFrame, value: str = "max_containment") -> DataFrame:
    """Rank 1.. by falling value, ties by sample. Places come from ranges of (value, sample), so that samples of one value are split as well."""
    falling = [F.col(value).isNull(), -F.col(value), F.col("sample")]
    return with_places(maxima.select("sample", value), falling, "rank").withColumn("rank", F.col("rank") + 1)
