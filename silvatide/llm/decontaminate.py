"""Benchmark decontamination by an FM-index over each shard of training text.

A shard is a run of documents of one task. Every window of every benchmark item
is looked up by backward search through the ranks of a wavelet matrix over the
shard's Burrows-Wheeler transform, all windows at once; occurrences are located
by sampled suffix positions, and overlapping ones merge to removal spans.

Words that no item holds cannot be part of an occurrence, and neither can a
stretch of item words shorter than the shortest window. The index is built over
all the remaining stretches, kept apart by a separator: exactly the text in
which a window can occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .succinct import FMIndex
from .tables import arrow_map, delete, filtered, only, table, written
from .textops import ALNUM, Words, chunks, column, hash_words, text_buffer

WINDOW = 13
#: Bytes of item text searched for at once (and broadcast); a larger benchmark is searched in several blocks.
BLOCK_BYTES = 16 << 20
#: A shard's index is built when this many words, documents or bytes of carried columns have gathered.
SHARD_WORDS = 1 << 20
SHARD_DOCS = 1 << 14
SHARD_BYTES = 64 << 20


ITEMS, SPANS = "_items", "_spans"


class Phrases:
    """The windows of a block of items, as arrays: item words by number, one after another, and of each window its start and its item."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.items = [str(i) for i, _ in items]
        data, off = text_buffer(pa.array([t for _, t in items], pa.string()))
        w = Words(data, off, ALNUM)
        code = w.code.tobytes()
        words = [code[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        vocabulary = sorted(set(words))
        h = hash_words(vocabulary)
        order = np.argsort(h, kind="stable")
        self.hashes, self.words = h[order], [vocabulary[k] for k in order.tolist()]
        number = {word: k + 1 for k, word in enumerate(self.words)}  # 0 separates
        self.seq = np.fromiter((number[x] for x in words), np.int32, len(words))
        n = np.diff(w.first)
        count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        self.item = np.repeat(np.arange(len(n)), count)
        self.starts = np.arange(len(self.item)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
        length = np.minimum(n, window)[self.item]
        self.shortest = int(length.min()) if len(length) else 0
        #: Windows by length.
        self.groups = [(int(x), np.flatnonzero(length == x)) for x in np.unique(length)]
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def numbers(self, w: Words) -> np.ndarray:
        """A number for each item word, found by hash and decided by its bytes; 0 for others. A hash that two item words share finds none but the first, so such words are looked for one by one."""
        out, h = np.zeros(len(w), np.int64), w.hashes()
        if len(self.hashes):
            maybe = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            ok = self.hashes[at] == h[maybe]
            maybe, at = maybe[ok], at[ok]
            while len(maybe):
                same = w.spelled(maybe, self.words, at)
                out[maybe[same]] = at[same] + 1
                maybe, at = maybe[~same], at[~same] + 1
                ok = (at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[maybe])
                maybe, at = maybe[ok], at[ok]
        return out


class Shard:
    """Documents of one task, until their index is built and searched."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.rows: list[pa.RecordBatch] = []
        self.n_words: list[np.ndarray] = []
        self.docs = self.kept = self.size = 0
        self.seq: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []

    def add(self, rows: pa.RecordBatch, w: Words) -> None:
        n = np.diff(w.first)
        if len(w) and len(self.p.starts):
            v = self.p.numbers(w)
            # Stretches of item words inside one document.
            inside = v > 0
            starts = np.zeros(len(w), bool)
            starts[w.first[:-1][n > 0]] = True
            begin = np.flatnonzero(inside & (starts | ~np.concatenate([[False], inside[:-1]])))
            last = np.concatenate([starts[1:], [True]])
            end = np.flatnonzero(inside & (last | ~np.concatenate([inside[1:], [False]]))) + 1
            long = end - begin >= self.p.shortest
            begin, end = begin[long], end[long]
            if len(begin):
                size = end - begin + 1  # and a separator
                out = np.zeros(len(size) + 1, np.int64)
                np.cumsum(size, out=out[1:])
                at = np.arange(out[-1]) - np.repeat(out[:-1], size) + np.repeat(begin, size)
                sep = np.zeros(len(at), bool)
                sep[out[1:] - 1] = True
                at = np.where(sep, at - 1, at)
                row = np.searchsorted(w.first, at, "right") - 1
                self.seq.append(np.where(sep, 0, v[at]))
                self.doc.append(row + self.docs)
                self.place.append(at - w.first[row])
                self.kept += len(at)
        self.rows.append(rows)
        self.size += rows.nbytes
        self.n_words.append(n)
        self.docs += len(n)

    def search(self, carried: list[str]) -> pa.RecordBatch:
        """The carried columns and what is found, joined with what rows that have items and spans bring from earlier blocks."""
        n_words = np.concatenate(self.n_words)
        n_hit = np.zeros(self.docs, np.int64)
        items: list[set[str]] = [set() for _ in range(self.docs)]
        spans: list[list[dict]] = [[] for _ in range(self.docs)]
        if self.kept:
            seq, doc, place = np.concatenate(self.seq), np.concatenate(self.doc), np.concatenate(self.place)
            index = FMIndex(seq)
            edge = np.zeros(len(seq) + 1, np.int64)
            for length, which in self.p.groups:
                lo, hi = index.ranges(self.p.seq, self.p.starts[which], length)
                n = hi - lo
                rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = index.locate(rows)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                for pair in np.unique(doc[at] * len(self.p.items) + np.repeat(self.p.item[which], n)).tolist():
                    d, k = divmod(pair, len(self.p.items))
                    items[d].add(self.p.items[k])
            hit = np.cumsum(edge[:-1]) > 0
            n_hit = np.bincount(doc[hit], minlength=self.docs)
            begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            end = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                spans[doc[a]].append({"start": int(place[a]), "end": int(place[b]) + 1})
        if ITEMS in self.rows[0].schema.names:
            at = 0
            for r in self.rows:
                before, found = column(r, SPANS), column(r, ITEMS)
                for k in np.flatnonzero(np.asarray(before.value_lengths())).tolist():
                    spans[at + k] = _merged(before[k].as_py() + spans[at + k])
                    items[at + k].update(found[k].as_py())
                    n_hit[at + k] = sum(x["end"] - x["start"] for x in spans[at + k])
                at += r.num_rows
        rows = [pa.concat_arrays([column(r, c) for r in self.rows]) for c in carried]
        return pa.RecordBatch.from_arrays(
            [*rows, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=[*carried, "_n_words", "_n_hit", ITEMS, SPANS],
        )


def _merged(spans: list[dict]) -> list[dict]:
    """Spans that overlap or touch, joined; in order of their starts."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and out[-1]["end"] >= s["start"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size, at least one; the driver reads a block at a time."""
    block: list[tuple[str, str | None]] = []
    size = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(text or "")
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item or "", text))
        size += n
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document, with the columns in `keep`, n_words, n_hit, items (ids of items with occurring windows, sorted) and spans (word ranges that
    occurrences cover, merged).

    Null and empty texts have no words and hit nothing; items without words have no window; items with equal windows are
    all reported; a null item id counts as an empty string. With an empty benchmark nothing is hit. Each row is judged by
    itself, whatever ids repeat. A benchmark of several blocks is searched in a pass over the rows for each block; the rows,
    with what was found so far, are written between the passes, so one block is held at a time.
    """
    b = only(benchmark, "item_id", "text")
    carried = [id_col, *keep]
    # Names of our own: what is written must not clash.
    own = {c: f"_c{k}" for k, c in enumerate(dict.fromkeys([*carried, "text"]))}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    passes = 0
    blocks = _blocks(b, block_bytes)
    block = next(blocks)
    while True:
        after = next(blocks, None)
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        found = _pass(rows, phrases, list(own.values()) if after else [own[c] for c in carried], own["text"])
        if not after:
            return found.select(*[F.col(own[c]).alias(c) for c in carried], *[F.col(f"_{c}").alias(c) for c in ("n_words", "n_hit", "items", "spans")])
        found = written(docs.sparkSession, found, "searched")
        if passes:
            delete(docs.sparkSession, rows)
        phrases.destroy()
        rows, block, passes = found, after, passes + 1


def _pass(rows: DataFrame, phrases: Broadcast, carried: list[str], text: str) -> DataFrame:
    """The rows, with the columns carried, searched for one block."""
    before = [c for c in (ITEMS, SPANS) if c in rows.columns]
    names = [*carried, *before]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried) + f", _n_words long, _n_hit long, {ITEMS} array<string>, {SPANS} array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(phrases.value)
        for x in batches:
            part = pa.RecordBatch.from_arrays([column(x, c) for c in names], names=names)
            data, off = text_buffer(column(x, text))
            for i, j in chunks(off):
                shard.add(part.slice(i, j - i), Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM))
                if shard.kept >= SHARD_WORDS or shard.docs >= SHARD_DOCS or shard.size >= SHARD_BYTES:
                    yield shard.search(carried)
                    shard = Shard(phrases.value)
        if shard.docs:
            yield shard.search(carried)

    return arrow_map(only(rows, *dict.fromkeys([*names, text])), run, schema)


def contaminated() -> F.Column:
    """The contract's rule: something is hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the contract's rule leaves, with all their columns; documents with fewer hits stay as they are. Null and empty texts
    stay, each of repeated rows is judged by itself, and an empty table gives no rows."""
    return filtered(docs, lambda d, keep: find_contamination(d, benchmark, keep=keep), ~contaminated())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; what find_contamination says of nulls, empty and repeated rows and empty tables holds."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS win FROM (
         SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS p FROM b)),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ln WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(x)), ',') AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
