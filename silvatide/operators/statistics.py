"""Tests, adjustments, outliers and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import f_tail, fisher_exact, hypergeometric_tail
from ..scratch import written
from .inversions import kendall
from .ordering import with_least_following, with_places
from .quantiles import joined, quantiles


def fold(observed: Column, expected: Column) -> Column:
    """observed / expected; at 0 expected infinity, or 1 if nothing is observed either."""
    return F.when(expected > 0, observed / F.nullif(expected.cast("double"), F.lit(0.0))).when(observed > 0, F.lit(float("inf"))).otherwise(1.0)


def enrichment(observed: DataFrame, expected: DataFrame, min_count: int = 5, key: str = "key", n: str = "n") -> DataFrame:
    """Keys of both tables unless both counts are below min_count: fold, Fisher's p against the totals over all keys, and its adjusted value."""
    o, e = observed.select(F.col(key).alias("key"), F.col(n).cast("long").alias("observed")), expected.select(F.col(key).alias("key"), F.col(n).cast("long").alias("expected"))
    totals = o.agg(F.sum("observed").alias("to")).crossJoin(e.agg(F.sum("expected").alias("te")))  # one row by one row
    j = o.join(e, "key").filter((F.col("observed") >= min_count) | (F.col("expected") >= min_count)).crossJoin(F.broadcast(totals))
    j = j.select("key", "observed", "expected", fold(F.col("observed"), F.col("expected")).alias("fold_enrichment"), fisher_exact(F.col("observed"), F.col("to") - F.col("observed"), F.col("expected"), F.col("te") - F.col("expected")).alias("p_value"))
    return benjamini_hochberg(j).orderBy(F.desc("fold_enrichment"), "key")


def benjamini_hochberg(df: DataFrame, p: str = "p_value", key: str = "key") -> DataFrame:
    """Adds adjusted_p_value: the least p * n / rank at or above each rank, at most 1; ranks by p, then key. The tests are written once, since their
    places take several passes; a row a range of p is all that one task sees."""
    d = written(df, "tests")
    n = d.agg(F.count("*").alias("_tests"))
    d = with_places(d, [F.col(p), F.col(key)], "_place", keep_range=True).crossJoin(F.broadcast(n))  # one row
    d = d.withColumn("_adj", F.col(p) * F.col("_tests") / (F.col("_place") + 1))
    d = with_least_following(d, "_adj", "_place", "_low")
    return d.withColumn("adjusted_p_value", F.least(F.lit(1.0), "_low")).drop("_adj", "_place", "_tests", "_low")


def hypergeometric(df: DataFrame, k: str, draws: str, successes: str, population: str) -> DataFrame:
    """Adds expected, fold_enrichment and p_value (upper tail). Impossible counts have null results."""
    c = {x: F.col(x).cast("long") for x in (k, draws, successes, population)}
    ok = (c[draws] <= c[population]) & (c[successes] <= c[population]) & (c[k] <= c[draws]) & (c[k] <= c[successes]) & (c[k] >= 0) & (c[population] > 0)
    expected = c[draws] * c[successes] / F.nullif(c[population].cast("double"), F.lit(0.0))
    return df.withColumns(
        {"expected": F.when(ok, expected), "fold_enrichment": F.when(ok, fold(c[k].cast("double"), expected)), "p_value": F.when(ok, hypergeometric_tail(c[k], c[population], c[successes], c[draws]))}
    )


def _long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.unpivot([key], list(columns), "metric", "x").filter("x IS NOT NULL")


def _sums(long: DataFrame) -> DataFrame:
    return long.groupBy("group", "metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def group_statistics(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """group, metric and its n, mean, std (sample), median, min, max. Medians are exact, by refined histograms."""
    long = _long(df, group, columns).withColumnRenamed(group, "group")
    q = quantiles(long, ["group", "metric"], "x", [0.5])
    return joined(_sums(long), q, ["group", "metric"]).select("group", "metric", "n", "mean", "std", F.get("q", F.lit(0)).alias("median"), "min", "max")


def describe(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """group, metric and its n, mean, std (sample), min, quartiles, max. Quartiles are exact, by refined histograms."""
    long = _long(df, group, columns).withColumnRenamed(group, "group")
    out = joined(_sums(long), quantiles(long, ["group", "metric"], "x", [0.25, 0.5, 0.75]), ["group", "metric"])
    return out.select("group", "metric", "n", "mean", "std", "min", *[F.get("q", F.lit(k)).alias(a) for k, a in enumerate(("q25", "q50", "q75"))], "max")


#: Below this variance of all values together there is nothing to test.
LEAST_VARIANCE = 1e-10


def group_tests(df: DataFrame, group: str, columns: Sequence[str], alpha: float = 0.05, order: Sequence[str] | None = None) -> DataFrame:
    """metric, test, groups, statistic, df1, df2, p_value, significant, for metrics with values in two groups at least.

    Two groups get the pooled t test (of the first in `order`, else by name, against the other), more a one-way analysis of variance. Where
    all values together hardly vary the test is skipped: a null statistic and a p of 1. Where groups are constant but
    different the statistic is infinite and p is 0. The deviations come from group sums, so one pass over the rows suffices.
    """
    g = _sums(_long(df, group, columns).withColumnRenamed(group, "group")).withColumn("ss", F.coalesce(F.col("std") * F.col("std"), F.lit(0.0)) * (F.col("n") - 1))
    place = F.col("group") if order is None else F.struct(F.array_position(F.array(*[F.lit(o) for o in order]), F.col("group").cast("string")).alias("at"), "group")
    t = g.groupBy("metric").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("mean")).alias("sx"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("sxx"),
        (F.min_by("mean", place) - F.max_by("mean", place)).alias("gap"),
    )
    t = t.filter("groups >= 2")
    between = F.greatest(F.lit(0.0), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    flat = (between + F.col("within")) / F.col("n") < LEAST_VARIANCE
    f = F.when(flat | (df2 < 1), F.lit(None).cast("double")).when(F.col("within") > 0, (between / df1) / F.nullif(F.col("within") / F.nullif(df2, F.lit(0)), F.lit(0.0))).otherwise(F.lit(float("inf")))
    two = F.col("groups") == 2
    t = t.select(
        "metric", F.when(flat, "skipped (identical values)").when(two, "t-test").otherwise("ANOVA").alias("test"), "groups", F.when(two, F.signum("gap") * F.sqrt(f)).otherwise(f).alias("statistic"), df1.alias("df1"), df2.alias("df2"), f.alias("_f")
    )
    tail = F.when(F.col("_f").isNull(), 1.0).when(F.col("_f") == float("inf"), 0.0).otherwise(f_tail(F.col("_f"), F.col("df1"), F.col("df2")))
    return t.withColumn("p_value", tail).withColumn("significant", F.col("p_value") < alpha).drop("_f")


def iqr_outliers(df: DataFrame, key: str, columns: Sequence[str], least_rows: int = 4) -> DataFrame:
    """key, metric, x of values outside the fences, over all rows together. The quartiles are one row a metric."""
    long = _long(df, key, columns)
    counts = long.groupBy("metric").agg(F.count("*").alias("n")).filter(F.col("n") >= least_rows)
    q = quantiles(long, ["metric"], "x", [0.25, 0.75]).join(counts, "metric")
    iqr = F.get("q", F.lit(1)) - F.get("q", F.lit(0))
    fences = q.select("metric", (F.get("q", F.lit(0)) - 1.5 * iqr).alias("low"), (F.get("q", F.lit(1)) + 1.5 * iqr).alias("high"))
    return long.join(F.broadcast(fences), "metric").filter("x < low OR x > high").select(key, "metric", "x")


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, r for every pair of columns, in one pass. Spearman's is Pearson's of average ranks."""
    if method == "spearman":
        df = ranked(df, columns)
    elif method == "kendall":
        return kendall(df, columns)
    elif method != "pearson":
        raise ValueError(f"unknown method {method}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("x")).select("x.*")


#: Ranges of the values that are ranked.
RANGES = 128


def ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average ranks of numbers, from counts of distinct values. Values are cut into ranges at their quantiles; only inside a range are they
    put in order, and the counts of the ranges before are added."""
    for c in columns:
        counts = df.groupBy(c).agg(F.count("*").alias("_n"))
        bounds = sorted(set(counts.select(F.col(c).cast("double").alias("x")).filter("x IS NOT NULL").approxQuantile("x", [k / RANGES for k in range(1, RANGES)], 0.001)))
        bins = F.lit(0) if not bounds else F.expr(f"cast(aggregate(array({', '.join(f'{b!r}D' for b in bounds)}), 0, (n, b) -> n + int(b < cast(`{c}` AS double))) AS int)")
        counts = counts.withColumn("_bin", bins)
        before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        ahead = counts.groupBy("_bin").agg(F.sum("_n").alias("_s")).select("_bin", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_ahead"))
        upto = F.sum("_n").over(Window.partitionBy("_bin").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        ranks = counts.withColumn("_upto", upto).join(F.broadcast(ahead), "_bin").select(c, (F.col("_ahead") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("_r"))
        df = df.join(ranks, c).drop(c).withColumnRenamed("_r", c)
    return df


# The texts of comparative recommendations.
DIFFERENT = ("Significant differences detected in: ", "Consider including group as covariate in downstream analysis")
OUTLYING = ("Outlier datasets detected: ", "Review outlier datasets for quality issues")
UNREMARKABLE = "No major issues detected in comparative analysis"


def comparative_recommendations(tests: DataFrame, outliers: DataFrame, metrics: Sequence[str], key: str = "key") -> DataFrame:
    """ordinal, text: what significant tests (in the order of `metrics`) and outliers (the first five by name) advise, else that all is well."""
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    t = tests.filter("significant").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "metric"))), lambda x: x["metric"]).alias("found"))
    # No more than six names are needed.
    o = outliers.select(F.col(key).cast("string").alias("k")).distinct().orderBy("k").limit(6).agg(F.array_sort(F.collect_list("k")).alias("out"))
    one = t.crossJoin(o)  # one row by one row
    some, more = F.size("found") > 0, F.size("out") > 0
    none = F.array().cast("array<string>")
    texts = F.concat(
        F.when(some, F.array(F.concat(F.lit(DIFFERENT[0]), F.array_join("found", ", ")), F.lit(DIFFERENT[1]))).otherwise(none),
        F.when(more, F.array(F.concat(F.lit(OUTLYING[0]), F.array_join(F.slice("out", 1, 5), ", "), F.when(F.size("out") > 5, "...").otherwise("")), F.lit(OUTLYING[1]))).otherwise(none),
        F.when(some | more, none).otherwise(F.array(F.lit(UNREMARKABLE))),
    )
    return one.select(F.posexplode(texts).alias("ordinal", "text"))


def compare_groups(profiles: DataFrame, groups: DataFrame, metrics: Sequence[str], key: str = "key", order: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The comparison of groups of datasets: frame (profiles with their group), statistics, tests, outliers, recommendations, summary and correlation.

    groups: key, group; `order` names the groups as they were given. A dataset without a profile is left out, as is a profile without a group; without any the one
    recommendation says that there is no data.
    """
    frame = profiles.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).join(groups.select(key, "group"), key)
    tests, outliers = group_tests(frame, "group", metrics, order=order), iqr_outliers(frame, key, metrics)
    advice = comparative_recommendations(tests, outliers, metrics, key)
    empty = frame.agg(F.count("*").alias("rows"))
    advice = advice.crossJoin(empty).select("ordinal", F.when(F.col("rows") > 0, F.col("text")).otherwise("No data available for analysis").alias("text"))
    return {
        "frame": frame, "statistics": group_statistics(frame, "group", metrics), "tests": tests, "outliers": outliers.select(key).distinct(), "recommendations": advice,
        "summary": describe(frame, "group", metrics), "correlation": correlation(frame, metrics),
    }
