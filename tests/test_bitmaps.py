"""Bitmaps and posting lists against sets."""

import random

import pytest

from silvatide.operators import bitmaps


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(2)
    rows = [(f"s{i:04d}", f"g{j}", r.choice([0.0, 0.5, 1.0])) for i in range(300) for j in range(6) if j == 0 or r.random() < 0.3]
    return rows, spark.createDataFrame(rows + rows[:50], "sample string, genome string, v double").repartition(5)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_posting_lists(spark, long, block):
    rows, df = long
    want = {}
    for s, g, v in rows:
        if v > 0:
            want.setdefault(g, set()).add(s)
    samples = bitmaps.sample_places(df)
    lists = bitmaps.postings(df, samples, block)
    made = lists.collect()
    assert max(x.n for x in made) <= block and all(list(x.offsets) == sorted(set(x.offsets)) and len(x.offsets) == x.n for x in made)
    got = {}
    for r in bitmaps.listed(lists, samples, block).collect():
        assert r.sample not in got.setdefault(r.genome, set())
        got[r.genome].add(r.sample)
    assert got == want
    assert bitmaps.both(lists, "g0", "g3").first().n == len(want["g0"] & want["g3"]) and bitmaps.both(lists, "g0", "none").first().n == 0
    with pytest.raises(ValueError):
        bitmaps.postings(df, samples, 0)


def test_rolled_up(spark):
    r = random.Random(5)
    rows = [(f"f{r.randint(0, 2)}", r.choice(["x", "y", None]), f"p{r.randint(0, 3)}", r.choice([*range(40), None]), r.random()) for _ in range(900)]
    df = spark.createDataFrame(rows, "a string, b string, c string, item int, v double").repartition(6)
    got = sorted(((x.a, x.b, x.c, x.samples, round(x["mean"], 9)) for x in bitmaps.rolled_up(df, ("a", "b", "c"), "item", "v").collect()), key=repr)
    want = []
    for k in (1, 2, 3):
        groups = {}
        for row in rows:
            groups.setdefault(row[:k] + (None,) * (3 - k), []).append(row)
        want += [(*g, len({x[3] for x in xs} - {None}), round(sum(x[4] for x in xs) / len(xs), 9)) for g, xs in groups.items()]
    assert got == sorted(want, key=repr)
