"""Kendall's tau by ranges against all pairs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from silvatide.operators import inversions
from silvatide.operators.inversions import concordance, grid_concordance, kendall, kendall_sum


def brute(x, y, w):
    x, y, w = (np.asarray(v) for v in (x, y, w))
    return (np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None]) * w[:, None] * w[None]).sum() / 2 if len(x) else 0.0


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9), st.integers(1, 4)), max_size=40))
def test_counting(rows):
    x, y, w = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [])))
    assert concordance(x, y, w) == brute(x, y, w) == grid_concordance(x, y, w)


@pytest.mark.parametrize("splitters", [2, 7, 128])
def test_ranges(spark, splitters):
    """Values that most rows share, texts, nulls and numbers that are none; any number of ranges gives the same."""
    rng = np.random.default_rng(splitters)
    x = np.where(rng.random(700) < 0.35, 5, rng.integers(0, 60, 700)).astype(float)
    y = np.where(rng.random(700) < 0.35, 3, rng.integers(-400, 400, 700) + x)
    rows = [(float(a), int(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, (None, 4), (float("nan"), 5), (1.0, None)], "x double, y long")
    one = kendall_sum(df, "x", "y", splitters).first()
    ties = lambda v: (np.unique(v, return_counts=True)[1] * (np.unique(v, return_counts=True)[1] - 1) / 2).sum()
    assert (one.s, one.n, one.tx, one.ty) == (brute(x, y, np.ones(700)), 700 * 699 / 2, ties(x), ties(y))
    text = spark.createDataFrame([(f"{a:05.0f}", b) for a, b in rows], "x string, y long")
    assert kendall_sum(text, "x", "y", splitters).first().s == one.s


def test_tau(spark):
    frame = pd.DataFrame({"a": [1, 2, 2, 4, 7, 7], "b": [3.5, 1.0, 1.0, 9.0, 2.0, 10.0], "c": [1, 1, 1, 1, 1, 1]})
    got = {(r.a, r.b): r.r for r in kendall(spark.createDataFrame(frame), ["a", "b", "c"]).collect()}
    s, n = brute(frame.a, frame.b, np.ones(6)), 15
    assert got["a", "b"] == pytest.approx(s / np.sqrt((n - 2) * (n - 1))) and got["a", "a"] == pytest.approx(1.0) and got["a", "c"] is None
    assert kendall(spark.createDataFrame([], "a int, b int"), ["a", "b"]).filter("a <> b").first().r is None


def test_no_pairs_are_joined(spark):
    df = spark.createDataFrame([(k % 5, k) for k in range(40)], "x int, y int")
    plan = inversions.kendall(df, ["x", "y"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
