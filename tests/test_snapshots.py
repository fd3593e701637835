"""Replaceable tables: whole or not at all."""

import pytest
from pyspark.sql import functions as F

from silvatide.sources.snapshots import Snapshots, checkpoints, load_checkpoint, remove_checkpoint, save_checkpoint


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_into_itself(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "cache"))
    assert s.load() is None and s.current() is None and s.names() == [] and s.prune() == [] and not s.remove()
    s.merge(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), ["k"])
    assert rows(s.load()) == [("a", 1), ("b", 2)]
    s.merge(s.load().filter("k = 'b'").withColumn("v", F.col("v") * 10), ["k"])
    assert rows(s.load()) == [("a", 1), ("b", 20)]
    s.save(s.load().withColumn("w", F.lit("x")))
    s.merge(spark.createDataFrame([("c", 3)], "k string, v int"), ["k"])
    assert rows(s.load().select("k", "v", "w")) == [("a", 1, "x"), ("b", 20, "x"), ("c", 3, None)]
    held = s.load()  # a reader of the table before the next
    s.save(held.filter("k = 'a'"))
    assert held.count() == 3 and s.load().count() == 1
    assert len(s.names()) == 5 and len(s.prune(2)) == 3 and s.load().count() == 1 and len(s.names()) == 2
    assert s.remove() and s.load() is None


def test_a_writer_that_fails_halfway(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "cache"))
    first = s.save(spark.range(100).withColumnRenamed("id", "k"))
    broken = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("k"))
    with pytest.raises(Exception, match="broken"):
        s.merge(broken, ["k"])
    assert s.current() == first and s.load().count() == 100 and s.names() == [first]
    assert not [p for p in (tmp_path / "cache").iterdir() if p.name.startswith(".current-") and not p.name.endswith(".crc")]


def test_two_writers(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "cache"))
    planned = s.save(spark.range(3))
    second = s.save(spark.range(4))
    with pytest.raises(RuntimeError):
        s.save(spark.range(5), planned)
    assert s.current() == second and s.load().count() == 4 and len(s.names()) == 2


def test_checkpoints(spark, tmp_path):
    top = str(tmp_path / "sessions")
    assert checkpoints(spark, top) == [] and load_checkpoint(spark, top, "s1").count() == 0
    one = spark.createDataFrame([("SRR1", "done", None), ("SRR2", "failed", "timeout")], "accession string, status string, detail string")
    save_checkpoint(spark, top, "s1", one)
    save_checkpoint(spark, top, "s1", spark.createDataFrame([("SRR2", "done", None), ("SRR3", "pending", None)], "accession string, status string, detail string"))
    save_checkpoint(spark, top, "s2", one.limit(1))
    assert rows(load_checkpoint(spark, top, "s1")) == [("SRR1", "done", None), ("SRR2", "done", None), ("SRR3", "pending", None)]
    assert checkpoints(spark, top) == ["s1", "s2"] and remove_checkpoint(spark, top, "s1") and checkpoints(spark, top) == ["s2"]
    assert not remove_checkpoint(spark, top, "s1")
