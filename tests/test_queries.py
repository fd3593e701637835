"""Every registered query of the engine against its oracle, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from silvatide import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for n in TABLES:
        p = f"{sf}/{n}.parquet"
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{p}{'/*.parquet' if Path(p).is_dir() else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = con.execute(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[c][~same].head().tolist(), b[c][~same].head().tolist())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["sample", "max_containment", "max_containment_annotation"]
