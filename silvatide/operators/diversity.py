"""Alpha and beta diversity, dispersion and PERMANOVA on a long abundance table: sample, feature, a."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .pairs import Rows, least, value_pairs
from .permutations import permanova_p
from .quantiles import joined, quantiles

EPSILON = 1e-12
ALPHA = ("shannon", "simpson", "chao1", "observed_species", "pielou")


def alpha(abundance: DataFrame, samples: DataFrame, n_features: int, metrics: Sequence[str] = ALPHA) -> DataFrame:
    """sample and one column a metric, for every sample of the dimension (0 for one without abundance).

    Every cell of the dense matrix gets EPSILON added in Shannon's index, so the absent cells count too: n_features is
    the number of features. Unknown metrics are left out.
    """
    cells = abundance.groupBy("sample", "feature").agg(F.sum("a").alias("a"))
    totals = cells.groupBy("sample").agg(F.sum("a").alias("total"))
    c = cells.join(totals, "sample").withColumn("p", F.col("a") / F.nullif("total", F.lit(0)))
    q = F.col("p") + EPSILON
    per = c.groupBy("sample").agg(
        F.sum(-q * F.ln(q)).alias("h"),
        F.count("*").alias("cells"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.count_if(F.col("a") > 0).alias("observed"),
        F.count_if(F.col("a") == 1).alias("f1"),
        F.count_if(F.col("a") == 2).alias("f2"),
        F.first("total").alias("total"),
    )
    s = samples.select("sample").join(per, "sample", "left").na.fill(0, ["observed", "f1", "f2", "cells"])
    any_ = F.coalesce(F.col("total") > 0, F.lit(False))
    absent = -EPSILON * math.log(EPSILON)
    shannon = F.when(any_, F.col("h") + (n_features - F.col("cells")) * absent).otherwise(0.0)
    observed = F.col("observed")
    made: dict[str, Column] = {
        "shannon": shannon,
        "simpson": F.when(any_, 1 - F.col("pp")).otherwise(0.0),
        "chao1": observed + F.when(F.col("f2") > 0, F.col("f1") * F.col("f1") / (2.0 * F.greatest("f2", F.lit(1)))).otherwise(F.col("f1") * (F.col("f1") - 1) / 2.0),
        "observed_species": observed.cast("long"),
        "pielou": F.when(observed <= 1, 0.0).otherwise(shannon / F.ln(F.greatest(observed, F.lit(2)).cast("double"))),
    }
    return s.select("sample", *[made[m].alias(m) for m in metrics if m in made])


def _ratio(x: np.ndarray, y: np.ndarray, where_none: float) -> np.ndarray:
    return np.where(y > 0, 1.0 - x / np.where(y > 0, y, 1.0), where_none)


def _bray_curtis(x: Rows, y: Rows, over: Callable) -> np.ndarray:
    return _ratio(2.0 * over(least), x.total(x.v)[:, None] + y.total(y.v)[None, :], 0.0)


def _jaccard(x: Rows, y: Rows, over: Callable) -> np.ndarray:
    both = over(lambda p, q: (p > 0).astype(float) @ (q > 0).astype(float).T)
    return _ratio(both, x.total(x.v > 0)[:, None] + y.total(y.v > 0)[None, :] - both, 0.0)


def _euclidean(x: Rows, y: Rows, over: Callable) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, x.total(x.v * x.v)[:, None] + y.total(y.v * y.v)[None, :] - 2.0 * over(lambda p, q: p @ q.T)))


def _manhattan(x: Rows, y: Rows, over: Callable) -> np.ndarray:
    saved = over(lambda p, q: np.stack([((r != 0) & (q != 0)) * (np.abs(r) + np.abs(q) - np.abs(r - q)) for r in p]).sum(2))
    return x.total(np.abs(x.v))[:, None] + y.total(np.abs(y.v))[None, :] - saved


def _cosine(x: Rows, y: Rows, over: Callable) -> np.ndarray:
    return _ratio(over(lambda p, q: p @ q.T), np.sqrt(x.total(x.v * x.v))[:, None] * np.sqrt(y.total(y.v * y.v))[None, :], 1.0)


METRICS = {"bray_curtis": _bray_curtis, "jaccard": _jaccard, "euclidean": _euclidean, "manhattan": _manhattan, "cosine": _cosine}


def beta(abundance: DataFrame, samples: DataFrame, metric: str = "bray_curtis") -> DataFrame:
    """a < b and their distance for every pair of samples, by tiles of blocks of samples: see pairs.

    Sums over the features that both samples have; norms and totals belong to the samples. Bray-Curtis takes non-negative abundances.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    x = abundance.select("sample", "feature", F.col("a").cast("double").alias("v")).groupBy("sample", "feature").agg(F.sum("v").alias("v"))
    return value_pairs(samples, x.filter("v <> 0"), METRICS[metric])


def _with_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    return pairs.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b")


def dispersion(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """group, mean, median and population deviation of the distances inside it; groups of one have none."""
    inside = written(_with_groups(pairs, groups).filter("ga = gb").select(F.col("ga").alias("group"), "distance"), "inside")
    sums = inside.groupBy("group").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"))
    return joined(sums, quantiles(inside, ["group"], "distance", [0.5]), ["group"]).select("group", "mean", F.get("q", F.lit(0)).alias("median"), "std")


def permanova_f(pairs: DataFrame, groups: DataFrame, textbook: bool = False) -> DataFrame:
    """One row: total, within, between, f_statistic, n, g.

    By default each sum of squares has the mean squared distance taken from it, as the original computes it: with U the
    sum of squared distances of n samples it is U / n - 2 U / (n (n - 1)). `textbook` gives U / n.
    """
    g = groups.toDF("sample", "group")
    sizes = g.groupBy("group").agg(F.count("*").alias("ng"))
    d2 = F.col("distance") * F.col("distance")
    u = _with_groups(pairs, g).filter("ga = gb").groupBy(F.col("ga").alias("group")).agg(F.sum(d2).alias("u"))

    def ss(u: Column, n: Column) -> Column:
        return u / n if textbook else u / n - 2 * u / (n * (n - 1))

    within = sizes.filter("ng > 1").join(u, "group", "left").agg(F.sum(ss(F.coalesce("u", F.lit(0.0)), F.col("ng"))).alias("within"))
    dims = sizes.agg(F.sum("ng").alias("n"), F.count("*").alias("g"))
    total = pairs.agg(F.sum(d2).alias("ut"))
    one = dims.crossJoin(total).crossJoin(within)  # rows of one
    one = one.withColumn("total", ss(F.coalesce("ut", F.lit(0.0)), F.col("n"))).withColumn("within", F.coalesce("within", F.lit(0.0)))
    between = F.col("total") - F.col("within")
    ok = (F.col("n") > F.col("g")) & (F.col("within") > 0) & (F.col("g") > 1)
    f = F.when(ok, (between / F.nullif(F.col("g") - 1, F.lit(0))) / F.nullif(F.col("within") / F.nullif(F.col("n") - F.col("g"), F.lit(0)), F.lit(0.0))).otherwise(0.0)
    return one.select("total", "within", between.alias("between"), f.alias("f_statistic"), "n", "g")


def aligned(samples: DataFrame, metadata: DataFrame, key: str = "sample") -> DataFrame:
    """The samples with their metadata; a sample without any is an error."""
    lost = [r[0] for r in samples.select(key).join(metadata.select(key), key, "left_anti").orderBy(key).limit(6).collect()]
    if lost:
        raise KeyError(f"no metadata for {', '.join(map(str, lost[:5]))}{' and others' if len(lost) > 5 else ''}")
    return samples.select(key).join(metadata, key)


def plot_frame(points: DataFrame, metadata: DataFrame, color: str | None = None, size: str | None = None, key: str = "sample") -> DataFrame:
    """Points with the metadata that a plot colours them and sizes them by. Every point must have metadata; a size that is null for any point is left out."""
    m = aligned(points, metadata, key)
    out = points.join(m.select(key, *[F.col(c).alias(n) for c, n in ((color, "color"), (size, "size")) if c]), key)
    return out.drop("size") if size and not out.filter("size IS NULL").isEmpty() else out


def permanova(pairs: DataFrame, samples: DataFrame, metadata: DataFrame, formula: str, permutations: int = 999, seed: int = 0) -> DataFrame:
    """variable, f_statistic, p_value, permutations of each variable of the formula, tested by itself. Every sample must have metadata."""
    m, out = aligned(samples, metadata), None
    for v in permanova_variables(formula):
        if v not in metadata.columns:
            raise KeyError(f"no column {v}")
        one = permanova_p(pairs, m.select("sample", v), permutations, seed).select(F.lit(v).alias("variable"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def permanova_variables(formula: str) -> list[str]:
    """The variables of a formula, each tested by itself."""
    return [v for part in formula.split("+") for v in part.split()]


def pca(wide: DataFrame, columns: Sequence[str], k: int = 3, key: str = "sample") -> DataFrame:
    """sample, components (array) of centred columns, with the share of variance of each in `explained`. Signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(wide)
    v = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=min(k, len(columns)), inputCol="_x", outputCol="_pc").fit(v)
    share = [float(x) for x in model.explainedVariance]
    return model.transform(v).select(key, vector_to_array("_pc").alias("components"), F.array(*[F.lit(x) for x in share]).alias("explained"))
