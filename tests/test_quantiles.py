"""Exact quantiles, places and running minima against plain lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvatide.operators import containment, statistics
from silvatide.operators.ordering import with_least_following, with_places
from silvatide.operators.quantiles import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def draws():
    r = random.Random(3)
    yield "even", [r.random() for _ in range(3000)]
    yield "one value mostly", [5.0] * 2000 + [r.gauss(0, 1) for _ in range(900)]
    yield "magnitudes", [(-1) ** k * 2.0 ** r.uniform(-1060, 1020) for k in range(2000)]
    yield "bounds", [math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, -5e-324, 0.0] * 30 + [r.gauss(0, 1e-300) for _ in range(200)]
    yield "neighbours", [float(np.nextafter(1.0, 2.0)) if k % 3 else 1.0 for k in range(99)]
    yield "one", [7.0]
    yield "two", [1.0, 2.0]


def test_quantiles(spark):
    rows = [(name, v) for name, vs in draws() for v in vs] + [(None, float(k)) for k in range(11)] + [("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", SHARES, gathered=20).collect()}
    assert "nothing" not in got and got[None] == [0.0, 1.0, 2.5, 5.0, 9.0, 10.0]
    for name, vs in draws():
        vs = sorted(vs)
        for s, q in zip(SHARES, got[name], strict=True):
            h = (len(vs) - 1) * s
            a, b = vs[math.floor(h)], vs[min(math.floor(h) + 1, len(vs) - 1)]
            want = a if h == math.floor(h) or a == b else (math.floor(h) + 1 - h) * a + (h - math.floor(h)) * b
            assert q == want, (name, s)


def test_quantiles_of_all_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"))
    assert quantiles(df, [], "v", [0.5]).first().q == [2499.5]


def test_statistics_with_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, None), (None, 2.0, 4), (None, 8.0, 6)], "g string, x double, y int")
    got = {(r.group, r.metric): (r.n, r["mean"], r.median, r["min"], r["max"]) for r in statistics.group_statistics(df.withColumn("y", F.col("y").cast("double")), "g", ["x", "y"]).collect()}
    assert got == {("a", "x"): (2, 2.0, 2.0, 1.0, 3.0), ("a", "y"): (1, 5.0, 5.0, 5.0, 5.0), (None, "x"): (2, 5.0, 5.0, 2.0, 8.0), (None, "y"): (2, 5.0, 5.0, 4.0, 6.0)}


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_places(spark, ranges):
    """All of one value, values of their own, nulls: any number of ranges gives the same places."""
    r = random.Random(1)
    rows = [(1.0 if k % 3 else r.random() if k % 2 else None, k) for k in range(500)]
    df = spark.createDataFrame(rows, "v double, k int").repartition(4)
    got = with_places(df, [F.col("v"), F.col("k")], "at", ranges, keep_range=True)
    want = {k: i for i, (_, _, k) in enumerate(sorted((v is not None, v or 0.0, k) for v, k in rows))}
    assert {x.k: x.at for x in got.collect()} == want
    if ranges > 1:
        sizes = [x["count"] for x in got.filter("v = 1").groupBy("_range").count().collect()]
        assert len(sizes) > 1  # the value that most rows share is split
    low = {x.at: x.low for x in with_least_following(got.withColumn("w", (F.col("k") * 7 % 31).cast("double")), "w", "at", "low").collect()}
    w = {i: float(k * 7 % 31) for k, i in want.items()}
    least = math.inf
    for i in range(499, -1, -1):
        least = min(least, w[i])
        assert low[i] == least


def test_ranks_of_one_value(spark):
    maxima = spark.range(1000).select(F.col("id").alias("sample"), F.lit(1.0).alias("max_containment"))
    assert {r.sample: r.rank for r in containment.rank_plot(maxima).collect()} == {k: k + 1 for k in range(1000)}
    assert containment.rank_plot(maxima.limit(0)).count() == 0


def test_many_tests_adjusted(spark):
    p = [((k * 7919) % 10007) / 10007 for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(p)), "key long, p_value double")
    got = {r.key: r.adjusted_p_value for r in statistics.benjamini_hochberg(df).collect()}
    low = 1.0
    for i, (v, k) in reversed(list(enumerate(sorted((v, k) for k, v in enumerate(p))))):
        low = min(low, v * 3000 / (i + 1))
        assert got[k] == pytest.approx(low, rel=1e-12)
    plan = statistics.benjamini_hochberg(df)._jdf.queryExecution().toString()
    assert "p_value" in plan
