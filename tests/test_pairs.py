"""Pairwise distances by tiles and permutation tests against plain array code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvatide.operators import containment, diversity, pairs, permutations


def test_presence_over_blocks(spark, monkeypatch):
    """Several blocks, more than 64 features, empty samples, repeated cells, samples that are texts."""
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = np.random.default_rng(4)
    on = rng.random((40, 150)) < 0.2
    on[[3, 17]] = False
    names = [f"s{k:02d}" for k in range(40)]
    rows = [(names[i], f"g{j}", 0.5) for i, j in zip(*np.nonzero(on), strict=True)]
    rows += [(names[0], "g999", 0.05)] + rows[:20] + [("other", "g1", 0.9)]
    long = spark.createDataFrame(rows, "sample string, genome string, v double")
    ids = spark.createDataFrame([(s,) for s in names + names[:3]], "sample string")
    for method in ("jaccard", "dice", "cosine"):
        got = {(r.a, r.b): r.distance for r in containment.presence_distance(long, 0.1, method, ids).collect()}
        assert len(got) == 40 * 39 // 2
        for i in range(40):
            for j in range(i + 1, 40):
                c, x, y = (on[i] & on[j]).sum(), on[i].sum(), on[j].sum()
                want = {"jaccard": 1.0 if x + y == c else 1 - c / (x + y - c), "dice": 1.0 if x + y == 0 else 1 - 2 * c / (x + y), "cosine": 1.0 if x * y == 0 else 1 - c / math.sqrt(x * y)}[method]
                assert got[names[i], names[j]] == pytest.approx(want, abs=1e-12)


def test_values_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "DENSE_BLOCK", 5)
    monkeypatch.setattr(pairs, "CHUNK", 3)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (23, 12)) * (rng.random((23, 12)) < 0.5)
    x[[2, 9]] = 0
    signed = x.astype(float) * np.where(rng.random(x.shape) < 0.3, -1, 1)
    for metric in diversity.METRICS:
        m = signed if metric in ("euclidean", "manhattan", "cosine", "jaccard") else x.astype(float)
        a = spark.createDataFrame([(i, f"f{j}", float(m[i, j])) for i in range(23) for j in range(12)], "sample int, feature string, a double")
        got = {(r.a, r.b): r.distance for r in diversity.beta(a, a.select("sample").distinct(), metric).collect()}
        assert len(got) == 23 * 22 // 2
        for i in range(23):
            for j in range(i + 1, 23):
                p, q = m[i], m[j]
                either, both = ((p > 0) | (q > 0)).sum(), ((p > 0) & (q > 0)).sum()
                norm = math.sqrt((p * p).sum()) * math.sqrt((q * q).sum())
                want = {
                    "bray_curtis": np.abs(p - q).sum() / (p + q).sum() if (p + q).sum() > 0 else 0.0,
                    "jaccard": 1 - both / either if either else 0.0,
                    "euclidean": math.sqrt(((p - q) ** 2).sum()),
                    "manhattan": np.abs(p - q).sum(),
                    "cosine": 1 - (p * q).sum() / norm if norm else 1.0,
                }[metric]
                assert got[i, j] == pytest.approx(want, abs=1e-9), metric


def test_no_pairs(spark):
    long = spark.createDataFrame([("a", "g", 0.5)], "sample string, genome string, v double")
    assert containment.presence_distance(long).count() == 0 and containment.presence_distance(long.limit(0)).count() == 0


def test_distances_need_no_join_of_samples(spark):
    long = spark.createDataFrame([(str(k), f"g{k % 3}", 0.5) for k in range(9)], "sample string, genome string, v double")
    plan = containment.presence_distance(long)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("method", ["cosine", "dice", "jaccard"])
def test_tiles_are_not_broadcast(spark, sf, method):
    """The planner takes one side of the tiles for no larger than the blocks; at 60 times sf0.1 it holds them 900 times."""
    from silvatide import catalog

    plan = catalog.QUERIES[f"distance_{method}"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_grown_blocks(spark, monkeypatch):
    """Blocks double while they stay small and enough tiles are left; the pairs are the same."""
    assert pairs._grown(900_000, 25, 1024, 1024) == 16384 and pairs._grown(15_000, 25, 1024, 1024) == 1024
    assert pairs._grown(900_000, 8000, 1024, 1024) == 1024 and pairs._grown(900_000, 2000, 1024, 1024) == 2048
    monkeypatch.setattr(pairs, "BLOCK", 2)
    monkeypatch.setattr(pairs, "LEAST_TILES", 6)
    rows = [(k, f"g{j}", 0.5) for k in range(60) for j in range(9) if (k * 7 + j * j) % 5 < 2]
    long = spark.createDataFrame(rows, "sample int, genome string, v double")
    ids = spark.range(64).select(F.col("id").cast("int").alias("sample"))
    grown = containment.presence_distance(long, 0.1, "cosine", ids).collect()
    monkeypatch.setattr(pairs, "MOST_BLOCK", 2)
    assert len(grown) == 64 * 63 // 2 and sorted(grown) == sorted(containment.presence_distance(long, 0.1, "cosine", ids).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutations_are_permutations(n):
    turns = np.repeat(np.arange(5), n)
    got = permutations.permuted(np.tile(np.arange(n), 5), turns, n, 3).reshape(5, n)
    assert (np.sort(got, axis=1) == np.arange(n)).all() and (got[0] == np.arange(n)).all()
    assert n < 64 or len({tuple(r) for r in got}) == 5


def test_permutations_are_even():
    """Each place of ten is reached about as often from each other; fixed points as many as chance makes."""
    turns = np.arange(1, 20001)
    got = np.stack([permutations.permuted(np.full(20000, k), turns, 10, 1) for k in range(10)])
    for row in got:
        count = np.bincount(row, minlength=10)
        assert abs(count - 2000).max() < 250
    assert (got == np.arange(10)[:, None]).sum(0).mean() == pytest.approx(1.0, abs=0.05)


def brute(d2, labels, permutations_, seed):
    n = len(labels)
    order = np.argsort(labels, kind="stable")
    d2, labels = d2[np.ix_(order, order)], np.sort(labels)

    def f(codes):
        part = lambda m: m.sum() / 2 / len(m) - m.sum() / (len(m) * (len(m) - 1))
        kinds = np.unique(codes)
        within = sum(part(d2[np.ix_(i, i)]) for g in kinds if len(i := np.flatnonzero(codes == g)) > 1)
        total = part(d2)
        return 0.0 if within <= 0 or len(kinds) < 2 or n <= len(kinds) else ((total - within) / (len(kinds) - 1)) / (within / (n - len(kinds)))

    seen = f(labels)
    drawn = [f(labels[permutations.permuted(np.arange(n), np.full(n, t), n, seed)]) for t in range(1, permutations_ + 1)]
    return seen, sum(x >= seen * (1 - 1e-12) for x in drawn) / permutations_


@pytest.mark.parametrize(("n", "turns", "block"), [(12, 300, 1024), (90, 100, 16), (2100, 12, 1024)])
def test_permanova_p(spark, n, turns, block):
    """One way below and above any size, and over several blocks."""
    rng = np.random.default_rng(n)
    labels = rng.integers(0, 3, n)
    at = rng.random((n, 3)) + 0.02 * labels[:, None]
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    i, j = np.triu_indices(n, 1)
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"a": i, "b": j, "distance": d[i, j]}))
    flipped = table.select(F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("b"), "distance")
    groups = spark.createDataFrame(pd.DataFrame({"sample": np.arange(n), "group": [f"g{x}" for x in labels]}))
    got = permutations.permanova_p(flipped, groups, turns, 7, block).first()
    f, p = brute(d * d, labels, turns, 7)
    assert got.f_statistic == pytest.approx(f, rel=1e-9) and got.p_value == pytest.approx(p, abs=1e-12) and got.permutations == turns


def test_permanova_p_edges(spark):
    d = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.5), (1, 9, 4.0)], "a int, b int, distance double")
    one = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "sample int, group string")
    assert tuple(permutations.permanova_p(d, one, 10).first()) == (0.0, 1.0, 10)
    none = permutations.permanova_p(d, one, 0).first()
    assert none.f_statistic == 0.0 and math.isnan(none.p_value)
    assert tuple(permutations.permanova_p(d.limit(0), one, 3).first()) == (0.0, 1.0, 3)


def test_components_of_all_genomes(spark, sf):
    """The first two components of the registered query against a decomposition of the whole matrix, up to their signs."""
    from silvatide import catalog

    wide = catalog.QUERIES["containment_wide"](spark, sf).toPandas().set_index("sample")
    x = wide[catalog.BRAND_NAMES].to_numpy(float)
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = catalog.QUERIES["pca"](spark, sf).toPandas().set_index("sample").loc[wide.index]
    for k in (0, 1):
        assert np.abs(np.abs(got[f"pc{k + 1}"].to_numpy()) - np.abs(u[:, k] * s[k])).max() < 1e-6
        assert got[f"share{k + 1}"].iloc[0] == pytest.approx(s[k] ** 2 / (s**2).sum(), abs=1e-8)
