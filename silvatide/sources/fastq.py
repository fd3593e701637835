"""FASTQ reads by Spark's text reader: any file system, compressed by suffix, large plain files in splits.

A first pass counts each split's lines and keeps the three at either end, a row a split. So the second pass knows where
records begin, and takes them from the lines of its split as they come; nothing but the lines at the edges, of which
records that cross a split are stitched, is shuffled. A limit reads each file by one task, which stops there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import arrow_map, written

SCHEMA = "accession string, file string, read_no long, seq string, qual string"
_RECORDS = "sid bigint, read_no bigint, l0 string, l1 string, l2 string, l3 string"
#: Splits up to which their table is broadcast, some hundred bytes each; beyond, lines meet it in a shuffle join.
MOST_SPLITS = 1 << 20


def _raw(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that agree in all columns."""
    n = len(columns[0])
    if not n:
        return []
    changed = np.zeros(n - 1, bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    cut = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _splits(raw: DataFrame) -> DataFrame:
    """path, file, split, sid, n (lines), ahead (lines of the file before it), first and last (its three lines at either end): a row a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "file", "split", "n", "first", "last"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
        key, n, first, last = None, 0, [], []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, n, first, last), kinds, strict=True)], names=names)
        for b in batches:
            split, value = b.column("split").to_numpy(), b.column("value")
            path = b.column("path").dictionary_encode()
            for s, e in _runs(split, path.indices.to_numpy()):
                at = (b.column("path")[s].as_py(), b.column("file")[s].as_py(), int(split[s]))
                if at != key:
                    if n:
                        yield row()
                    key, n, first, last = at, 0, [], []
                if len(first) < 3:
                    first = (first + value[s : min(e, s + 3)].to_pylist())[:3]
                last = (last + value[max(s, e - 3) : e].to_pylist())[-3:]
                n += e - s
        if n:
            yield row()

    each = written(arrow_map(raw, run, "path string, file string, split bigint, n bigint, first array<string>, last array<string>").withColumn("sid", F.monotonically_increasing_id()), "splits")
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    return each.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _records(lines: DataFrame, partial: bool) -> DataFrame:
    """The whole records of each sid, from lines (sid, ahead, value) that come in their order; with `partial` what is left at the end too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(sid: int, line: np.ndarray, columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(line), sid)), pa.array(line // 4), *columns], names=["sid", "read_no", "l0", "l1", "l2", "l3"])

        def ended() -> Iterator[pa.RecordBatch]:
            if partial and len(left):
                yield made(key, np.array([at - len(left)]), [pa.array([x], pa.string()) for x in (left.to_pylist() + [None] * 4)[:4]])

        key, at, left = None, 0, pa.array([], pa.string())
        for b in batches:
            sids, value = b.column("sid").to_numpy(), b.column("value")
            for s, e in _runs(sids):
                if sids[s] != key:
                    yield from ended()
                    key, at, left = int(sids[s]), b.column("ahead")[s].as_py(), pa.array([], pa.string())
                rows = pa.concat_arrays([left, value[s:e]]) if len(left) else value[s:e]
                start = at - len(left)
                skip = -start % 4  # lines of a record that began before the split
                whole = max(0, (len(rows) - skip) // 4)
                if whole:
                    first = skip + 4 * np.arange(whole)
                    yield made(key, start + first, [rows.take(pa.array(first + k)) for k in range(4)])
                left = rows[skip + 4 * whole :] if len(rows) >= skip else rows[:0]
                at += e - s
        yield from ended()

    return arrow_map(lines, run, _RECORDS)


def _stitched(splits: DataFrame) -> DataFrame:
    """path, file, read_no, l0 to l3 of the records that no split holds whole."""
    first = F.transform("first", lambda v, i: F.struct((F.col("ahead") + i).alias("line"), v.alias("value")))
    last = F.transform("last", lambda v, i: F.struct((F.col("ahead") + F.col("n") - F.size("last") + i).alias("line"), v.alias("value")))
    edges = splits.select("path", "file", "ahead", "n", F.explode(F.array_distinct(F.concat(first, last))).alias("e")).select("path", "file", "ahead", "n", "e.*")
    r = F.floor(F.col("line") / 4)
    crossing = edges.filter((4 * r < F.col("ahead")) | (4 * r + 3 >= F.col("ahead") + F.col("n")))
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(f"l{k}")
    return crossing.groupBy("path", "file", r.alias("read_no")).agg(*[at(k) for k in range(4)]).drop("path")


def _all(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, read_no, l0 to l3."""
    raw = _raw(spark, paths)
    splits = written(_splits(raw), "ahead")
    known = splits.select("path", "split", "sid", "ahead")
    names = splits.select("sid", "file")
    if splits.count() <= MOST_SPLITS:
        known, names = F.broadcast(known), F.broadcast(names)
        lines = raw.select("path", "split", "value").join(known, ["path", "split"], "left")
    else:
        raw = raw.withColumn("id", F.monotonically_increasing_id())
        lines = raw.select("path", "split", "value", "id").join(known, ["path", "split"], "left").repartition("sid").sortWithinPartitions("sid", "id")
    # The second pass must find the splits of the first.
    sid = F.coalesce("sid", F.raise_error(F.lit("the files were split anew")).cast("long")).alias("sid")
    whole = _records(lines.select(sid, "ahead", "value"), False).join(names, "sid").drop("sid")
    return whole.unionByName(_stitched(splits))


def _first(spark: SparkSession, paths: Sequence[str], reads: int) -> DataFrame:
    """The same of the first reads of each file. One task reads a file's splits one after another and stops at the last line that is wanted."""
    files = sorted(spark.read.text(list(paths)).inputFiles())
    out = None
    for k, f in enumerate(files):
        one = spark.read.text(unquote(f)).select(F.lit(k).cast("long").alias("sid"), F.col("_metadata.file_block_start").alias("split"), "value").coalesce(1).limit(4 * reads)
        out = one if out is None else out.unionByName(one)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, split = -1, 0
        for b in batches:
            ids, starts = b.column("sid").to_numpy(), b.column("split").to_numpy()
            for s, e in _runs(ids):
                split = split if ids[s] == sid else 0
                sid = int(ids[s])
                if np.any(np.diff(starts[s:e], prepend=split) < 0):
                    raise ValueError("the splits of a file came out of order")
                split = int(starts[e - 1])
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(np.zeros(len(ids), np.int64)), b.column("value")], names=["sid", "ahead", "value"])

    if out is None:
        return spark.createDataFrame([], "file string, read_no bigint, l0 string, l1 string, l2 string, l3 string")
    lines = arrow_map(out, in_order, "sid bigint, ahead bigint, value string")
    names = spark.createDataFrame([(k, f) for k, f in enumerate(files)], "sid bigint, path string")  # one row a file that was named
    file = F.element_at(F.split("path", "/"), -1)
    return _records(lines, True).join(F.broadcast(names), "sid").select(file.alias("file"), "read_no", "l0", "l1", "l2", "l3")


def read(spark: SparkSession, paths: Sequence[str], limit: int = 0, strict: bool = True) -> DataFrame:
    """accession, file, read_no, seq, qual of these files, of each the first `limit` reads if it is above 0. A record whose lines do not begin
    with @ and + is an error; without `strict` it is left out. Blank lines at a file's end are no records."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    r = _first(spark, paths, limit) if limit else _all(spark, paths)
    r = r.withColumn("file", F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))))  # Spark names files as in a URI
    r = r.filter(F.concat_ws("", "l0", "l1", "l2", "l3") != "")
    fine = F.coalesce(F.col("l0").startswith("@") & F.col("l2").startswith("+") & F.col("l3").isNotNull(), F.lit(False))
    if strict:
        problem = F.raise_error(F.concat(F.lit("broken record "), F.col("read_no").cast("string"), F.lit(" in "), "file")).cast("string")
        seq = F.when(fine, F.col("l1")).otherwise(problem)
    else:
        r, seq = r.filter(fine), F.col("l1")
    return r.select(F.regexp_extract("file", r"^[^_.]*", 0).alias("accession"), "file", F.col("read_no").cast("long").alias("read_no"), seq.alias("seq"), F.col("l3").alias("qual"))


def head(spark: SparkSession, paths: Sequence[str], reads: int = 10_000) -> DataFrame:
    """The first reads of each file; files without any read are an error."""
    out = read(spark, paths, reads)
    if out.isEmpty():
        raise ValueError(f"no reads in {', '.join(paths) or 'no file'}")
    return out


def zero_length(reads: DataFrame) -> DataFrame:
    """The files that hold a read without a base: their profile fails."""
    return reads.filter(F.length("seq") == 0).select("accession", "file").distinct()
