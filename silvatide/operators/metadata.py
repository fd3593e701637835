"""Counting and summarising metadata tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"no column {name}; there are {', '.join(df.columns)}")


def counts_by_genome(long: DataFrame, metadata: DataFrame, column: str, threshold: float = 0.5, key: str = "sample") -> DataFrame:
    """genome, value, n: metadata rows of the samples above the threshold. Duplicate metadata rows count, nulls do not."""
    require_column(metadata, column)
    hits = long.filter(F.col("v") > threshold).select("sample", "genome").distinct()
    m = metadata.select(F.col(key).alias("sample"), F.col(column).alias("value")).filter("value IS NOT NULL")
    return hits.join(m, "sample").groupBy("genome", "value").agg(F.count("*").alias("n"))


def counts_wide(long: DataFrame, metadata: DataFrame, column: str, genomes: Sequence[str], threshold: float = 0.5, key: str = "sample") -> DataFrame:
    """One row a value, one column a genome, 0 where nothing is counted."""
    return counts_by_genome(long, metadata, column, threshold, key).groupBy("value").pivot("genome", list(genomes)).sum("n").na.fill(0)


def column_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("genome").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "genome")


def single_genome_counts(long: DataFrame, metadata: DataFrame, genome: str, column: str, threshold: float = 0.1, top_n: int = 100, key: str = "sample") -> DataFrame:
    require_column(metadata, column)
    hits = long.filter((F.col("genome") == genome) & (F.col("v") > threshold)).select("sample")
    m = metadata.withColumnRenamed(key, "sample").join(hits, "sample", "left_semi").filter(F.col(column).isNotNull())
    return m.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top_n)


def crosstab(df: DataFrame, category: str, value: str, values: Sequence[str], min_count: int = 1) -> DataFrame:
    """Counts of value by category without nulls; categories of min_count at least, largest first."""
    t = df.filter(F.col(category).isNotNull() & F.col(value).isin(*values)).groupBy(category).pivot(value, list(values)).count().na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return t.withColumn("_total", total).filter(F.col("_total") >= min_count).orderBy(F.desc("_total"), category).drop("_total")


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """non_null, total, percent and distinct."""
    c = F.col(column)
    return df.agg(F.count(c).alias("non_null"), F.count("*").alias("total"), (100.0 * F.count(c) / F.nullif(F.count("*"), F.lit(0))).alias("percent"), F.count_distinct(c).alias("distinct"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    out = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return out if limit is None else out.orderBy(F.desc("n"), "value").limit(limit)


def non_null_counts(df: DataFrame, skip_prefixes: Sequence[str] = ("Run_", "Project_", "Sample_", "Experiment_")) -> DataFrame:
    """name, n of every column without a standard prefix; one aggregate pass."""
    names = [c for c in df.columns if not c.startswith(tuple(skip_prefixes))]
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names])
    return one.unpivot([], [f"`{c}`" for c in names], "name", "n").orderBy(F.desc("n"), "name")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in an explicit, full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def present(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have, key, "left_semi")


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have, key, "left_anti")


def ordered_distinct(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(ordinal).alias(ordinal)).orderBy(ordinal)


def completeness(df: DataFrame, limit: int = 15) -> DataFrame:
    """The fullest columns: name, n, percent."""
    total = df.agg(F.count("*").alias("total"))
    return non_null_counts(df, ()).crossJoin(total).select("name", "n", (100.0 * F.col("n") / F.nullif("total", F.lit(0))).alias("percent")).orderBy(F.desc("n"), "name").limit(limit)


def grouped_pivot(df: DataFrame, x: str, group: str, value: str, groups: Sequence[str], limit: int | None = None) -> DataFrame:
    """Sums by x and group; the x with the largest totals."""
    t = df.groupBy(x).pivot(group, list(groups)).sum(value).na.fill(0)
    if limit is None:
        return t
    total = sum((F.col(f"`{g}`") for g in groups[1:]), F.col(f"`{groups[0]}`"))
    return t.withColumn("_total", total).orderBy(F.desc("_total"), x).drop("_total").limit(limit)


def plot_rows(df: DataFrame, x: str, y: str | None, limit: int) -> DataFrame:
    """The rows of the largest y; without y the first by x."""
    return df.orderBy(F.desc(y), x).limit(limit) if y else df.orderBy(x).limit(limit)


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"))
