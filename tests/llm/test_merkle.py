"""The manifest against hashes made one by one."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from silvatide.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def brute(rows):
    """Rows of (doc_id, text, lang, source, n_chars), by plain lists."""

    def leaf(doc_id, text, lang, source, n_chars):
        out = b""
        for v in (doc_id, source, lang, n_chars, text):
            e = b"" if v is None else str(v).encode()
            out += b"-" if v is None else b"%d:" % len(e) + e
        return sha(out)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 8]).encode()) for i in range(0, len(last), 8)])
        return levels

    def steps(levels, i):
        for level in levels[:-1]:
            yield i % 8, level[i // 8 * 8 : i // 8 * 8 + 8]
            i //= 8

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for at, g in enumerate(langs):
        for i, (_, _, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = [*steps(trees[g], i), *steps(top, at)]
            proof = sha("".join(d for k, run in way for j, d in enumerate(run) if j != k).encode())
            f = h
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                f = leaf(r[0], r[1].translate(lower), *r[2:])
            for k, run in way:
                f = sha("".join([*run[:k], f, *run[k + 1 :]]).encode())
            out.append((r[0], h, trees[g][-1][0], top[-1][0], proof, f, f == top[-1][0]))
    return sorted(out, key=repr)


def said(df):
    return sorted((tuple(r) for r in merkle.manifest(merkle.document_leaves(df)).collect()), key=repr)


def many_languages():
    """75 languages (two levels above the subroots), of 1 to 75 rows; ids over many places, one language with five levels' worth of odd ends."""
    rows = [(k * 1000 + i, f"Text {i} of {k}", f"l{k:03d}", "s", i) for k in range(75) for i in range(k % 20 + 1)]
    return rows + [(10**9 + 7 * i, "A" if i % 2 else "a", "zz", None, None) for i in range(521)]


CASES = {
    "one row": [(3, "Only", "en", "s", 4)],
    "one language": [(i, f"T{i}", "en", "s", i) for i in range(9)],
    "exact powers": [(i, f"T{i}", "en", "s", i) for i in range(64)] + [(100 + i, "x", "de", "s", 1) for i in range(8)],
    "odd ends": [(i, f"T{i}", "en", "s", i) for i in range(65)] + [(500, "x", "de", "s", 1)],
    "many": many_languages(),
    # Nulls in any column, empty and very long texts, repeated ids and rows, colons and dashes, other letters.
    "edges": [(None, None, None, None, None), (None, "", "", "", 0), (None, "B", None, "-", 1), (5, "Äö A", "fr", "s:1", 4), (5, "other", "fr", "s", 5), (5, "Äö A", "fr", "s:1", 4), (-3, "Q" * 300000, "fr", "s", 300000)]
    + [(7, "Same", "en", "s", 4)] * 40,
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_manifest(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert said(df) == brute(rows)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}).convert_dtypes(dtype_backend="pyarrow"))
    assert sorted(con.execute(merkle.ORACLE_SQL).fetchall(), key=repr) == brute(rows)


def test_order_of_columns_and_clashes(spark):
    rows = CASES["odd ends"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "group": F.lit(1), "changed": F.lit(None), "n": F.lit(2)})
    assert said(df.select("n", "text", "leaf", "lang", "doc_id", "group", "source", "n_chars", "changed")) == brute(rows)


def test_empty(spark):
    out = merkle.manifest(merkle.document_leaves(spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_run_that_misses_a_node_is_an_error():
    with pytest.raises(RuntimeError):
        merkle._closed(((0, 1, 0), [(3, 0, b"a", None), (3, 2, b"c", None)]))


def test_nothing_is_left(spark):
    import os

    from silvatide.llm.tables import shared_dir

    merkle.manifest(merkle.document_leaves(spark.createDataFrame(CASES["odd ends"], SCHEMA))).count()
    left = [n for n in os.listdir(shared_dir(spark).removeprefix("file://")) if n.startswith(("leaves-", "level", "top", "ways", "entries-"))]
    assert not left


def test_nothing_is_left_of_a_run_that_fails(spark):
    import os

    from silvatide.llm.tables import shared_dir, swept, written

    there = lambda: {n for n in os.listdir(shared_dir(spark).removeprefix("file://"))}
    written(spark, spark.range(1), "first")  # so that the folder is there
    before = there()
    with pytest.raises(RuntimeError), swept(spark) as kept:
        kept.append(written(spark, spark.range(3), "part"))
        raise RuntimeError
    assert there() == before


def test_supersteps_climb_several_levels(spark, monkeypatch):
    """A tree of five levels takes two supersteps up, not one a level; the blocks at its end are odd."""
    saved, was = [], merkle._saved
    monkeypatch.setattr(merkle, "_saved", lambda spark, rdd, name: saved.append(name) or was(spark, rdd, name))
    rows = [(3 * i, f"Text {i}", "en", "s", i) for i in range(8**3 * 9 + 1)]
    assert said(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert sorted(n for n in saved if n.startswith("level")) == ["level1", "level2"]
