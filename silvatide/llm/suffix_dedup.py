"""Suffix-array dedup: remove bytes covered by strings that also start in an earlier document.

Which strings of LENGTH bytes occur in several documents is decided by suffix
arrays over shards of passages. A passage surrounds an anchor: by winnowing,
every string of LENGTH bytes holds an anchor chosen from its content alone, so
equal strings meet in the shard of their anchor's hash.

1. Of equal texts the one of least id is kept as source; the others go whole.
2. A string of LENGTH bytes reaches far to the left of its anchor (LEFT bytes at least) or
   far to the right. So two passages of an anchor hold a common string only if they
   agree in the anchor with LEFT bytes before it or with RIGHT bytes after it. Those
   that agree in neither with a passage of another document are left out; the rows
   are made and matched in SLICES of the anchors, which bounds the disk they take.
3. Of equal passages one is kept, with the least and the largest id they have.
4. Where an anchor has one passage, all its strings have the passage's least id
   as source. The other passages are dealt to shards by anchor and sorted there by
   induced sorting; neighbouring suffixes with a common prefix of LENGTH
   or more are one string, whose source is its least id. An anchor with more than
   HOT_PASSAGES passages is first split by the bytes next to it: its strings that
   reach far to the left all hold the same number of bytes left of the anchor, the
   others of bytes right of it, so equal strings stay together. Halves that are still
   too large are split again; after the fifth time a part is one string.
5. Strings of larger ids mark their bytes; a document's marks merge to spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .induced import common_prefix_reaches, sort_suffixes
from .tables import arrow_map, delete, only, table, written
from .textops import _BYTE_CODE, chunks, column, mix, powers, text_buffer

_U = np.uint64
LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # bytes of a passage on either side of its anchor
#: Bytes before an anchor, or after it, of which a string of LENGTH has one number or the other at least.
LEFT, RIGHT = REACH // 2, REACH - REACH // 2 + 1
#: The anchors are made and matched in so many slices, one after another.
SLICES = 2
#: Bytes in which the least grams are looked for at once: few, so that their arrays stay in the cache.
SEGMENT = 1 << 16
SHARD_BYTES = 2 << 20
#: Passages of an anchor that are sorted together; an anchor with more is split by the bytes next to it.
HOT_PASSAGES = 1 << 12


class Sums:
    """Hashes of any byte ranges of a chunk."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        code = _BYTE_CODE.take(data)
        code *= up[: len(data)]
        np.cumsum(code, out=self.sums[1:])

    def all(self, begin: int, end: int, size: int) -> np.ndarray:
        """Hashes of the ranges of `size` bytes that start from begin to before end."""
        h = self.sums[begin + size : end + size] - self.sums[begin:end]
        h *= self.down[begin:end]
        return mix(h)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(data: np.ndarray, off: np.ndarray, sums: Sums, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the chunk of the least gram (the first of equals) of every string of `length` bytes inside a row, and the grams' hashes."""
    n = len(data)
    w = length - gram + 1
    mark = np.zeros(n, bool)
    low = (_U(1) << _U(22)) - _U(1)  # a place in a segment; the rest of the hash decides, at any length of text
    none = ~_U(0)  # no place: they stay below `low`
    edges = off[(off > 0) & (off < n)]
    for begin in range(0, n - length + 1, SEGMENT):
        end = min(begin + SEGMENT + w - 1, n - gram + 1)
        least = sums.all(begin, end, gram)
        least &= ~low
        least |= np.arange(end - begin, dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])  # least[i]: over the grams of the string at begin + i
        first, last = np.searchsorted(edges, [begin + 1, begin + len(least) + length])
        for o in edges[first:last].tolist():  # strings that would cross into the next row
            least[max(0, o - length + 1 - begin) : max(0, o - begin)] = none
        found = least[np.concatenate([[True], least[1:] != least[:-1]])]
        mark[begin + (found[found != none] & low).astype(np.int64)] = True
    pos = np.flatnonzero(mark)
    return pos, sums.hash(pos, pos + gram)


PLACE = "h long, doc long, passage long, version long, pos long, shape long, left int, right int"


def _anchor_rows(texts: DataFrame, slice_: int) -> DataFrame:
    """The places of one slice of the anchors: the anchor's hash, passage digest, version, position in the row, shape (128 * bytes before the anchor
    + bytes) of the passage, and hashes of the anchor with LEFT bytes before and with RIGHT bytes after it (null where the text ends sooner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "doc_id").to_numpy(zero_copy_only=False)
            version = column(b, "version").to_numpy(zero_copy_only=False)
            data, off = text_buffer(column(b, "text"))
            for i, j in chunks(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                sums = Sums(part)
                pos, h = anchors(part, o, sums)
                own = h % _U(SLICES) == _U(slice_)
                pos, h = pos[own], h[own]
                row = np.searchsorted(o, pos, "right") - 1
                lo, hi = np.maximum(pos - REACH, o[row]), np.minimum(pos + GRAM + REACH, o[row + 1])
                shape = (pos - lo) * 128 + (hi - lo)
                digest = mix(sums.hash(lo, hi) ^ shape.astype(np.uint64))
                left, right = sums.hash(np.maximum(pos - LEFT, lo), pos), sums.hash(pos + GRAM, np.minimum(pos + GRAM + RIGHT, hi))
                cols = [h.view(np.int64), ids[i + row], digest.view(np.int64), version[i + row], pos - o[row], shape]
                cols = [pa.array(c.astype(np.int64)) for c in cols]
                half = lambda x, short: pa.array((x >> _U(32)).astype(np.uint32).view(np.int32), mask=short)
                cols += [half(left, pos - lo < LEFT), half(right, hi - pos - GRAM < RIGHT)]
                whole = pa.RecordBatch.from_arrays(cols, names=["h", "doc", "passage", "version", "pos", "shape", "left", "right"])
                for x in range(0, whole.num_rows, 1 << 18):
                    yield whole.slice(x, 1 << 18)

    return arrow_map(texts, run, PLACE)


def _shared_places(texts: DataFrame, slice_: int) -> DataFrame:
    """The places of a slice that can hold a string of another document. A document has hundreds of anchors for each it shares with very many
    others, so the rows of one anchor are few beside a task's; they are sorted on disk where they do not fit."""
    rows = _anchor_rows(texts, slice_)

    def shared(*by: str) -> F.Column:
        w = Window.partitionBy(*by)
        return F.min("doc").over(w) < F.max("doc").over(w)

    rows = rows.withColumn("_h", shared("h")).filter("_h")
    rows = rows.withColumn("_l", F.col("left").isNotNull() & shared("h", "left")).withColumn("_r", F.col("right").isNotNull() & shared("h", "right"))
    return rows.filter("_l OR _r").select("h", "doc", "passage", "version", "pos", "shape")


def _passages(kept: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of the passages kept: h, passage, lo, hi, bytes, left (bytes before the anchor)."""
    per_doc = kept.groupBy("doc", "version").agg(F.collect_list(F.struct("pos", "h", "passage", "lo", "hi")).alias("at"))
    rows = texts.join(per_doc, (texts["doc_id"] == per_doc["doc"]) & (texts["version"] == per_doc["version"])).select("text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffer(column(b, "text"))
            at = column(b, "at")
            size = np.asarray(at.value_lengths())
            flat = at.flatten()
            row = np.repeat(np.arange(len(size)), size)
            pos = flat.field("pos").to_numpy() + off[row]
            lo, hi = np.maximum(pos - REACH, off[row]), np.minimum(pos + GRAM + REACH, off[row + 1])
            n = hi - lo
            for x in range(0, len(pos), 1 << 15):
                s = slice(x, x + (1 << 15))
                ends = np.cumsum(n[s])
                take = np.arange(ends[-1]) - np.repeat(ends - n[s], n[s]) + np.repeat(lo[s], n[s])
                raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[take])])
                yield pa.RecordBatch.from_arrays([*(flat.field(c)[s] for c in ("h", "passage", "lo", "hi")), raw, pa.array(pos[s] - lo[s])], names=["h", "passage", "lo", "hi", "bytes", "left"])

    return arrow_map(rows, run, "h long, passage long, lo long, hi long, bytes binary, left long")


def _halves(passages: DataFrame) -> DataFrame:
    """Passages cut in two, each with the key of its part: strings with a to mid - 1 bytes left of the anchor, and with mid to b. A part of one string stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in range(0, whole.num_rows, 1 << 13):
                t = whole.slice(x, 1 << 13)
                key, a, b, left = (column(t, c).to_numpy() for c in ("key", "a", "b", "left"))
                data, off = text_buffer(column(t, "bytes"))
                size, anchor = np.diff(off), off[:-1] + left
                sums = Sums(data)
                mid = (a + b + 1) // 2
                for far in (True, False):
                    low, high = (mid, b) if far else (a, mid - 1)
                    # The passage holds a string of the half.
                    row = np.flatnonzero((low <= high) & (np.maximum(low, LENGTH - (size - left)) <= np.minimum(high, left)))
                    if not len(row):
                        continue
                    low, high, at = low[row], high[row], anchor[row]
                    h = sums.hash(at - low, at) if far else sums.hash(at + GRAM, at + LENGTH - high)
                    made = mix(key[row].view(np.uint64) ^ mix(h + (low * 64 + high).astype(np.uint64))).view(np.int64)
                    made = np.where(a[row] == b[row], key[row], made)
                    lo, hi = np.maximum(at - high, off[row]), np.minimum(at + LENGTH - low, off[row + 1])
                    n = hi - lo
                    ends = np.cumsum(n)
                    take = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo, n)
                    raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[take])])
                    same = t.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*(column(same, c) for c in ("h", "passage", "lo", "hi")), raw, *(pa.array(c.astype(np.int64)) for c in (at - lo, made, low, high))],
                        names=["h", "passage", "lo", "hi", "bytes", "left", "key", "a", "b"],
                    )

    return arrow_map(passages, run, "h long, passage long, lo long, hi long, bytes binary, left long, key long, a long, b long")


def _split(passages: DataFrame, limit: int) -> DataFrame:
    """What _sources finds for the passages of large anchors, of which no more than `limit` are sorted together."""
    spark = passages.sparkSession
    rows = passages.select("*", F.col("h").alias("key"), F.lit(0).cast("long").alias("a"), F.lit(REACH).cast("long").alias("b"))
    small, found = [], []
    for _ in range(REACH.bit_length()):
        rows = written(spark, _halves(rows), "halves")
        # Each key here has more than `limit` rows, so there are few.
        large = written(spark, rows.groupBy("key").agg(F.count("*").alias("n"), F.min("lo").alias("source")).filter(F.col("n") > limit), "large")
        small.append(rows.join(F.broadcast(large), "key", "left_anti"))
        rows = rows.join(F.broadcast(large), "key", "left_semi")
        if large.isEmpty():
            break
    else:  # equal keys are equal strings now
        one = rows.join(F.broadcast(large.select("key", "source")), "key").filter("source < hi")
        found.append(one.select("h", "passage", "source", (-F.col("a")).alias("begin"), (LENGTH - F.col("a")).alias("end")))
    small = reduce(DataFrame.unionByName, small).select("h", "passage", "lo", "hi", "bytes", "left", "key")
    return reduce(DataFrame.unionByName, [_sources(small.repartition("key").sortWithinPartitions("key")), *found])


def _sources(passages: DataFrame) -> DataFrame:
    """For each passage the runs of string starts (relative to the anchor) and the least id of a document that holds those strings.

    Runs whose source is no less than the passage's own largest id mark nothing and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Passages come sorted by anchor, or by the key of its part: a shard ends where one does, once it is large enough.
        held, size, limit = [], 0, SHARD_BYTES
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < limit:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("key" if "key" in t.column_names else "h").to_numpy()
            ends = np.flatnonzero(h[1:] != h[:-1]) + 1
            if not len(ends):
                limit = 2 * size  # one anchor alone fills the shard
                continue
            yield from search(t.slice(0, int(ends[-1])))
            rest = t.slice(int(ends[-1]))
            held, size, limit = rest.to_batches(), rest.nbytes, SHARD_BYTES
        if held:
            yield from search(pa.Table.from_batches(held))

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        if not t.num_rows:
            return
        h, passage, lo, hi, left = (t.column(c).to_numpy() for c in ("h", "passage", "lo", "hi", "left"))
        raw = t.column("bytes").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        data, off = text_buffer(raw)
        size = np.diff(off)
        # Passages with a separator (1) after each and the least symbol (0) last; bytes of UTF-8 are moved up by 2.
        start = off[:-1] + np.arange(len(size))
        seq = np.ones(len(data) + len(size) + 1, np.uint8)
        seq[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data + 2
        seq[-1] = 0
        # Only suffixes that are the start of a whole string of LENGTH bytes inside their passage matter; what stands between two that agree is one too.
        owner = np.append(np.repeat(np.arange(len(size)), size + 1), 0)
        whole = np.arange(len(seq)) + LENGTH <= (start + size)[owner]
        whole[-1] = False
        sa = sort_suffixes(seq)
        sa = sa[whole[sa]]
        if not len(sa):
            return
        same = common_prefix_reaches(seq, sa, LENGTH)
        own = owner[sa]
        first = np.flatnonzero(~same)
        source = np.repeat(np.minimum.reduceat(lo[own], first), np.diff(first, append=len(sa)))
        useful = source < hi[own]
        if not useful.any():
            return
        at = np.zeros(len(seq), bool)
        at[sa[useful]] = True
        of = np.empty(len(seq), np.int64)
        of[sa] = source
        sa = np.flatnonzero(at)
        own, source = owner[sa], of[sa]
        rel = sa - start[own] - left[own]
        cut = np.concatenate([[True], (own[1:] != own[:-1]) | (source[1:] != source[:-1]) | (rel[1:] != rel[:-1] + 1)])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(own)) - 1
        o = own[first]
        for x in range(0, len(first), 1 << 17):
            s = slice(x, x + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(c[s].astype(np.int64)) for c in (h[o], passage[o], source[first], rel[first], rel[last] + LENGTH)], names=["h", "passage", "source", "begin", "end"])

    return arrow_map(passages, run, "h long, passage long, source long, begin long, end long")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, digest, n_bytes, source: the least id with an equal text, version) and spans (doc, version, begin, end: bytes to remove, sorted and merged)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    profile = docs.filter("doc_id IS NOT NULL").select("doc_id", F.md5(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).distinct()
    least = profile.groupBy("digest", "n_bytes").agg(F.min("doc_id").alias("source"))
    repeated = profile.groupBy("doc_id").agg(F.count("*").alias("texts"))
    known = profile.join(least, ["digest", "n_bytes"])
    # A version tells apart the texts of rows that repeat an id.
    known = known.join(repeated, "doc_id").select("doc_id", "digest", "n_bytes", "source", F.when(F.col("texts") > 1, F.xxhash64("digest")).otherwise(F.lit(0)).cast("long").alias("version"))
    known = written(spark, known, "profile")
    firsts = known.filter((F.col("doc_id") == F.col("source")) & (F.col("n_bytes") >= LENGTH)).select("doc_id", "digest", "version")
    texts = docs.select("doc_id", "text", F.md5(text.cast("binary")).alias("digest")).join(firsts, ["doc_id", "digest"]).select("doc_id", "version", "text")
    texts = written(spark, texts, "sources")

    parts = [written(spark, _shared_places(texts, x), "places") for x in range(SLICES)]
    places = reduce(DataFrame.unionByName, parts)
    one = places.groupBy("h", "passage").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "version", "pos")).alias("at"), F.max("shape").alias("shape"))
    one = written(spark, one.select("h", "passage", "lo", "hi", "at.doc", "at.version", "at.pos", "shape"), "passages")
    several = written(spark, one.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "several")
    hot = several.filter(F.col("n") > HOT_PASSAGES).select("h")
    left = F.floor(F.col("shape") / 128)
    alone = one.join(several, "h", "left_anti").filter("lo < hi").select("h", "passage", F.col("lo").alias("source"), (-left).alias("begin"), (F.col("shape") % 128 - left).alias("end")).filter(f"end - begin >= {LENGTH}")
    mixed = one.join(several, "h", "left_semi").select("h", "passage", "lo", "hi", "doc", "version", "pos")
    split = None if hot.isEmpty() else written(spark, _split(_passages(mixed.join(F.broadcast(hot), "h", "left_semi"), texts), HOT_PASSAGES), "split")
    few = mixed if split is None else mixed.join(F.broadcast(hot), "h", "left_anti")
    sorted_ = _sources(_passages(few, texts).repartition("h").sortWithinPartitions("h"))
    found = alone.unionByName(sorted_)
    found = written(spark, found if split is None else found.unionByName(split), "strings")
    delete(spark, one, several)
    hits = places.join(found, ["h", "passage"]).filter("source < doc").select("doc", "version", (F.col("pos") + F.col("begin")).alias("begin"), (F.col("pos") + F.col("end")).alias("end"))
    spans = hits.groupBy("doc", "version").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    spans = written(spark, spans, "spans")
    delete(spark, texts, *parts, found, *([] if split is None else [split]))
    return known, spans


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch, joined; in order of their starts."""
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


def dedup(docs: DataFrame, id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges), kept_sha256, and (with_text) the remaining bytes, for every row.

    A byte goes if it is covered by a string of 50 bytes that also starts in a document with a smaller id, judged on the
    input. Null text is empty; texts under 50 bytes lose nothing. Rows that repeat an id never lose bytes to each other;
    a row without an id neither loses bytes nor takes any. An empty table gives no rows; other columns are ignored.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("text"))
    known, spans = repeated_spans(d)
    whole = (F.col("source") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH)
    marks = known.join(spans, (known["doc_id"] == spans["doc"]) & (known["version"] == spans["version"]), "left").select(known["doc_id"], "digest", whole.alias("whole"), "spans").filter("whole OR spans IS NOT NULL")
    rows = d.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(marks, ["doc_id", "digest"], "left").select("doc_id", "text", "whole", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffer(column(b, "text"))
            n_removed, spans_out, digests, kept_out = [], [], [], []
            lists = column(b, "spans")
            size = np.asarray(lists.value_lengths().fill_null(0))
            flat = lists.flatten()
            pairs = np.stack([flat.field("begin").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False)], 1).astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(size)])
            for k, whole in enumerate(column(b, "whole").to_pylist()):
                raw = data[off[k] : off[k + 1]]
                gone = np.array([[0, len(raw)]], np.int64) if whole else _merged(pairs[cut[k] : cut[k + 1]])
                kept, at = [], 0
                for x, y in gone.tolist():
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                rest = b"".join(p.tobytes() for p in kept)
                n_removed.append(len(raw) - len(rest))
                spans_out.append([{"begin": x, "end": y} for x, y in gone.tolist()])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept_out.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(np.diff(off)), pa.array(n_removed, pa.int64()), pa.array(spans_out, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(digests, pa.string()), pa.array(kept_out, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
            )

    out = arrow_map(rows, run, "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; what dedup says of nulls, short, repeated and equal texts and empty tables holds."""
    out = dedup(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
