"""Exact quantiles by refined histograms.

The values between two bounds are counted in BUCKETS buckets; the bucket that holds a wanted place gives new bounds, its own least and
greatest value. Each pass divides the values that are left by BUCKETS or so, and always leaves its least and greatest out of each other's
bucket; once GATHERED or fewer are left they are sorted. So the passes go with the logarithm of the rows, and no task's
state grows with the number of different values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

BUCKETS = 4096
#: Values between two bounds that are sorted at once: two megabytes, of 128 groups a task at most (then Spark's aggregation sorts by group first).
GATHERED = 1 << 18


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys in which nulls are equal; the left keys stay."""
    r = right.select(*[F.col(k).alias(f"_r{i}") if k in keys else F.col(k) for i, k in enumerate(right.columns)])
    names = {k: f"_r{i}" for i, k in enumerate(right.columns) if k in keys}
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(names[k]))
    return left.join(r, on, how).drop(*names.values())


def _bucket(x: Column, lo: Column, hi: Column, logs: bool) -> Column:
    """A bucket that never falls as x rises: 0 for the lower bound alone, BUCKETS - 1 for the upper; by value, or by order of magnitude."""
    scale = (lambda v: F.signum(v) * F.when(F.abs(v) > 1, 300 + F.log2(F.abs(v))).otherwise(F.log2(1 + F.abs(v) * 2.0**300))) if logs else (lambda v: v * 0.5)
    share = (scale(x) - scale(lo)) / F.nullif(scale(hi) - scale(lo), F.lit(0.0))
    inner = F.when((share >= 0) & (share <= 1), 1 + F.floor(share * (BUCKETS - 3))).otherwise(1)  # infinite bounds, or none: the inner ones stay together
    return F.when(x == lo, 0).when(x == hi, BUCKETS - 1).otherwise(inner).cast("int")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], buckets_by_log_from: int = 3, gathered: int = GATHERED) -> DataFrame:
    """keys and q, the quantiles of `value` (a double; nulls do not count) at these shares, between neighbours in proportion. A group without
    values has no row. Reads df once for each pass: write a dear one first.
    """
    keys = list(keys)
    x = df.select(*keys, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    n = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    places = F.array(*[F.struct(F.floor((F.col("n") - 1) * F.lit(float(s)) + e).cast("long").alias("k")) for s in shares for e in (0.0, 1.0)])
    # k: a wanted place; lo, hi: bounds of the value there; m: values between them; skip: values below.
    t = n.select(*keys, "n", F.explode(F.array_distinct(places)).alias("p"), "lo", "hi", F.col("n").alias("m"), F.lit(0).cast("long").alias("skip")).select(*keys, "n", F.least(F.col("p.k"), F.col("n") - 1).alias("k"), "lo", "hi", "m", "skip").distinct()
    t = written(t, "places")
    turn = 0
    wide = lambda: F.col("lo") < F.col("hi")
    while (t.filter(wide()).agg(F.max("m")).first()[0] or 0) > gathered:  # one number
        turn += 1
        open_ = wide() & (F.col("m") > gathered)
        bounds = t.filter(open_).select(*keys, "lo", "hi").distinct()
        inside = joined(x, bounds, keys).filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        b = inside.withColumn("b", _bucket(F.col("x"), F.col("lo"), F.col("hi"), turn >= buckets_by_log_from and turn % 2 == 1))
        b = b.groupBy(*keys, "lo", "hi", "b").agg(F.count("*").alias("c"), F.min("x").alias("b_lo"), F.max("x").alias("b_hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("b"))  # BUCKETS rows
        b = b.withColumn("before", upto - F.col("c"))
        found = joined(t.filter(open_), b, [*keys, "lo", "hi"])
        at = F.col("k") - F.col("skip") - F.col("before")
        found = found.filter((at >= 0) & (at < F.col("c"))).select(*keys, "n", "k", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), F.col("c").alias("m"), (F.col("skip") + F.col("before")).alias("skip"))
        t = written(t.filter(~open_).unionByName(found), "places")
    few = t.filter(wide()).select(*keys, "lo", "hi").distinct()
    sorted_ = joined(x, few, keys).filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # `gathered` values at most
    t = joined(t, sorted_, [*keys, "lo", "hi"], "left").withColumn("v", F.when(F.col("xs").isNull(), F.col("lo")).otherwise(F.get("xs", (F.col("k") - F.col("skip")).cast("int"))))
    all_ = t.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_set(F.struct("k", "v"))).alias("at"))  # two places a share

    def between(s: float) -> Column:
        h = (F.col("n") - 1) * F.lit(float(s))
        low = F.floor(h).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", F.least(low + 1, F.col("n") - 1))
        return F.when((h == low) | (a == b), a).otherwise((low + 1 - h) * a + (h - low) * b)

    return all_.select(*keys, F.array(*[between(s) for s in shares]).alias("q"))
