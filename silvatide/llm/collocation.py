"""Phrase collocations: how much oftener words stand together than their parts let expect.

1. Texts are cut into pieces and words and written as shards: at most SHARD_BYTES of one language (a longer piece stands
   alone), as the shard's different words and, word after word, their numbers, with a 0 between pieces.
2. A sketch of one row and 2**CELL_BITS cells counts all phrases of one to three words, a cell being a hash of language and
   phrase. It is too wide for one machine and most of it is empty, so it is kept as sorted cells: each shard sends
   those that it has, ranges of cells are summed, and a cell's sum is an upper bound for each of its phrases. Each shard gets
   back those of its cells that reach the least count. Sums are kept up to the least count only: more is not asked.
3. The phrases of those cells, told apart by their words, are a shard's candidates. They are compiled into an Aho-Corasick
   automaton that scans the shard once and counts all matches, overlapping ones too. For it a word is spelled in a few
   letters, the fewer the more often it stands there, the first of which delimits words and tells the length: no match
   begins or ends inside a word. Counts are summed over the shards; what stays under the least count goes.
4. Joins by phrase bring the counts of the parts; scores are exact (decimals of 38 digits).

A group is a shard or a range of cells, both of bounded size; a phrase that every text holds is one row a shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice, product
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import arrow_map, only, ship, swept, table, written
from .textops import column, hash_words, mix

_U = np.uint64
SHARD_BYTES = 4 << 20
#: Bytes of shards of all languages that a task holds open.
OPEN_BYTES = 16 << 20
CELL_BITS = 40
#: Cells of a range that are summed together, about.
RANGE_CELLS = 1 << 20
#: Bytes of a word's number in a shard, and bits of a cell that among() looks at first.
NUMBER_BYTES = 4
MARK_BITS = 22
#: Letters of each place of a word's spelling.
LETTERS = 64
LONGEST = 3
LEAST = 10
SHARE = (50, 100)
TOP = 2000
NO_LANG = "und"

# What cuts pieces; A-Z are lower-cased.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(BREAKS))


def normalised(text: bytes) -> tuple[list[bytes], int]:
    """The pieces of a text, their words with single spaces between, and the number of words."""
    pieces, n = [], 0
    for piece in text.translate(_FOLD).split(b"\n"):
        words = piece.split()
        if words:
            pieces.append(b" ".join(words))
            n += len(words)
    return pieces, n


def numbered(body: bytes) -> tuple[list[bytes], np.ndarray]:
    """The different words of a body (single spaces between all words, line feeds as words between pieces) and the number of each
    of its words in turn; number 0 is the line feed."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = body.split(b" ")
    number[b"\n"]
    row = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return list(number), row


def planes(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bytes, byte plane by byte plane, so that what compresses the shuffle finds the planes of zeros."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(raw: bytes, width: int) -> np.ndarray:
    by = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((by.shape[1], 8), np.uint8)
    out[:, :width] = by.T
    return out.view("<u8").ravel()


def write_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, lang, words, vocab, body of the texts of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # pieces, their bytes, words

        def closed(lang: str) -> pa.RecordBatch:
            pieces, _, words = held.pop(lang)
            vocab, row = numbered(b" \n ".join(pieces))
            return pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([words], pa.int64()), pa.array([b" ".join(vocab)], pa.binary()), pa.array([planes(row, NUMBER_BYTES)], pa.binary())],
                names=["lang", "words", "vocab", "body"],
            )

        for b in batches:
            for lang, text in zip(column(b, "lang").to_pylist(), column(b, "text"), strict=True):
                raw = text.as_buffer() if text.is_valid else None
                if not raw:
                    continue
                pieces, words = normalised(raw.to_pybytes())
                lang = NO_LANG if lang is None else lang
                part = held.setdefault(lang, [[], 0, 0])
                for p in pieces:
                    if part[1] and part[1] + len(p) > shard_bytes:
                        yield closed(lang)
                        part = held.setdefault(lang, [[], 0, 0])
                    part[0].append(p)
                    part[1] += len(p) + 3
                    part[2] += p.count(b" ") + 1
                while sum(x[1] for x in held.values()) > OPEN_BYTES:
                    yield closed(max(held, key=lambda k: held[k][1]))
        for lang in [k for k, x in held.items() if x[1]]:
            yield closed(lang)

    made = arrow_map(only(docs, "lang", "text"), run, "lang string, words bigint, vocab binary, body binary")
    return written(docs.sparkSession, made.select(F.monotonically_increasing_id().alias("shard"), "lang", "words", "vocab", "body"), "shards")


class Grams:
    """The phrases of one to LONGEST words of a shard: 64-bit hashes, cells, and the place of the first word of each."""

    def __init__(self, lang: str, body: bytes):
        self._found(lang, *numbered(body))

    @classmethod
    def read(cls, lang: str, vocab: bytes, body: bytes) -> Grams:
        """Of a row of write_shards."""
        made = cls.__new__(cls)
        made._found(lang, vocab.split(b" "), from_planes(body, NUMBER_BYTES).astype(np.int64))
        return made

    def _found(self, lang: str, vocab: list[bytes], row: np.ndarray) -> None:
        self.vocab, self.row = vocab, row
        own, word = hash_words(vocab), row > 0
        # A hash of k words extends that of k - 1; phrases stay inside their piece.
        h, own, here, out = mix(own ^ hash_words([lang.encode()])[0])[row], own[row], word, []
        for k in range(1, LONGEST + 1):
            if k > 1:
                h = mix(h[:-1] * _U(0xD6E8FEB86659FD93) + own[k - 1 :]) if len(h) > 1 else h[:0]
                here = here[: len(h)] & word[k - 1 :]
            at = np.flatnonzero(here)
            out.append((h[at], at))
        self.hash, self.place = (np.concatenate(x) for x in zip(*out, strict=True))
        self.ends = np.cumsum([len(x) for x, _ in out])
        self.cell = self.hash >> _U(64 - CELL_BITS)

    def among(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each length, the numbers of the words of the different phrases whose cell is among these (sorted) cells: a row for each
        word of the phrases, a column for each phrase."""
        if not len(cells):
            return [np.zeros((k, 0), np.int64) for k in range(1, LONGEST + 1)]
        # Most phrases outside fail at the last bits of their cell; the rest are looked up once for each different phrase.
        last, mark = _U((1 << MARK_BITS) - 1), np.zeros(1 << MARK_BITS, bool)
        mark[cells & last] = True
        near, out = np.flatnonzero(mark[self.cell & last]), []
        for k, end in enumerate(self.ends.tolist(), 1):
            own = near[(near < end) & (near >= (self.ends[k - 2] if k > 1 else 0))]
            at = self.place[own]
            key, size = self.row[at], len(self.vocab)
            for j in range(1, k):
                if size * len(self.vocab) >= 1 << 63:
                    key = np.unique(key, return_inverse=True)[1]
                    size = len(key)
                key = key * len(self.vocab) + self.row[at + j]
                size *= len(self.vocab)
            first = np.unique(key, return_index=True)[1]
            cell = self.cell[own[first]]
            at = at[first[cells[np.minimum(np.searchsorted(cells, cell), len(cells) - 1)] == cell]]
            out.append(np.stack([self.row[at + j] for j in range(k)]))
        return out

    def spelled(self, phrases: np.ndarray, words: list) -> Iterator[tuple]:
        """The words of each phrase (numbers as among() gives them), taken from a list of one for each number."""
        return zip(*[map(words.__getitem__, x) for x in phrases.tolist()], strict=True)

    def candidates(self, cells: np.ndarray) -> list[bytes]:
        """The different phrases whose cell is among these (sorted) cells, in order."""
        return sorted(b" ".join(p) for phrases in self.among(cells) for p in self.spelled(phrases, self.vocab))

    def letters(self, numbers: np.ndarray) -> list[str]:
        """A spelling for each number of a word: one of its own for these (different) numbers, the shortest for what stands in the shard
        most often; "\\0", which is in no spelling, for all others and between pieces."""
        often = np.bincount(self.row, minlength=len(self.vocab))[numbers]
        out = ["\0"] * len(self.vocab)
        for x, letters in zip(numbers[np.argsort(-often, kind="stable")].tolist(), spellings(len(numbers)), strict=True):
            out[x] = letters
        return out


def spellings(n: int) -> list[str]:
    """n different strings, short ones first. The first letter tells the length and is no later letter of any: in a chain of them
    each is found only where it was put."""
    later = [chr(1 + x) for x in range(LETTERS)]
    chains = (product([chr(1 + LETTERS * size + x) for x in range(LETTERS)], *[later] * (size - 1)) for size in count(1))
    return list(map("".join, islice(chain.from_iterable(chains), n)))


def packed(cells: np.ndarray) -> bytes:
    """Sorted cells as planes of their differences."""
    return planes(np.diff(cells, prepend=_U(0)), CELL_BITS // 8)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, CELL_BITS // 8), dtype=np.uint64)


def sketched(shards: DataFrame, ranges: int, least: int) -> DataFrame:
    """range, shard, cells, counts: the sketch of each shard, cut into ranges of cells; counts up to `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, lang, vocab, body in zip(b.column("shard").to_pylist(), b.column("lang").to_pylist(), b.column("vocab"), b.column("body"), strict=True):
                cells, n = np.unique(Grams.read(lang, vocab.as_py(), body.as_py()).cell, return_counts=True)
                n = np.minimum(n, least)
                where = (cells * _U(ranges)) >> _U(CELL_BITS)
                cut = np.flatnonzero(np.diff(where, prepend=where[:1] + _U(1))) if len(where) else np.zeros(0, np.int64)
                ends = np.append(cut[1:], len(cells))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(where[cut].astype(np.int64), pa.int64()),
                        pa.array(np.full(len(cut), shard), pa.int64()),
                        pa.array([packed(cells[s:e]) for s, e in zip(cut, ends, strict=True)], pa.binary()),
                        pa.array([n[s:e].astype("<u2").tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary()),
                    ],
                    names=["range", "shard", "cells", "counts"],
                )

    return arrow_map(shards.select("shard", "lang", "vocab", "body"), run, "range bigint, shard bigint, cells binary, counts binary")


def frequent_cells(sketch: DataFrame, least: int) -> DataFrame:
    """shard, cells: of each shard's cells those whose sum over all shards reaches `least`."""
    ship(sketch.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        each = [unpacked(x.as_py()) for x in t.column("cells").combine_chunks()]
        n = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in t.column("counts").combine_chunks()])
        whole, back = np.unique(np.concatenate(each), return_inverse=True)
        kept = (np.bincount(back, n, len(whole)) >= least)[back]
        out, at = [], 0
        for cells in each:
            out.append(packed(cells[kept[at : at + len(cells)]]))
            at += len(cells)
        t = pa.table({"shard": t.column("shard"), "cells": pa.array(out, pa.binary())})
        return t.filter(pa.array([len(x) > 0 for x in out]))

    return sketch.groupBy("range").applyInArrow(run, "shard bigint, cells binary")


def counted(shards: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang, phrase, n: the occurrences of each candidate in each shard, found by one automaton a shard."""
    ship(shards.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        lang, phrases, n = "", [], []
        if len(left) and len(right):
            lang = left.column("lang")[0].as_py()
            cells = np.sort(np.concatenate([unpacked(x.as_py()) for x in right.column("cells").combine_chunks()]))
            grams = Grams.read(lang, left.column("vocab")[0].as_py(), left.column("body")[0].as_py())
            found = grams.among(cells)
            phrases = [b" ".join(p) for x in found for p in grams.spelled(x, grams.vocab)]
        if phrases:
            letters = grams.letters(np.unique(np.concatenate([x.ravel() for x in found])))
            machine = ahocorasick.Automaton()
            for k, p in enumerate(p for x in found for p in grams.spelled(x, letters)):
                machine.add_word("".join(p), k)
            machine.make_automaton()
            matches = machine.iter("".join(map(letters.__getitem__, grams.row.tolist())))
            n = np.bincount(np.fromiter(map(itemgetter(1), matches), np.int64), minlength=len(phrases))
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64())})

    return shards.select("shard", "lang", "vocab", "body").groupBy("shard").cogroup(frequent.groupBy("shard")).applyInArrow(run, "lang string, phrase string, n bigint")


def phrase_counts(shards: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, f of every phrase of one to LONGEST words that occurs `least` times in its language."""
    if not 1 <= least < 1 << 16:
        raise ValueError("the least count must lie in [1, 65535]")
    words = shards.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]  # one number
    ranges = min(1 << 23, max(1, -(-LONGEST * words // RANGE_CELLS)))
    counts = counted(shards, frequent_cells(sketched(shards, ranges, least), least))
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly: a has 15 digits at most, so no product has more than 36."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1000000).cast("decimal(7,0)"), big(l) * big(r))


def scored(counts: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of several words that no longer one holds to `share` (50 of 100 times or more)."""
    c = counts.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w"))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    many = c.filter("k > 1")
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda k: F.struct(k.alias("cut"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.col("k") - k), " ").alias("right"))))
    cut = many.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("c")).select("lang", "phrase", "a", "c.*")
    known = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(n))
    both = cut.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])  # a part occurs as often as the whole at least
    best = both.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("b"))
    inner = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))))
    longer = c.filter("k > 2").select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(share[1]) * F.col("longer") < F.lit(share[0]) * F.col("b.a")))
    return kept.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, share: tuple[int, int] = SHARE, top: int | None = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language (all, if None), by score, then count, falling, then by their bytes.

    docs: lang, text, whatever other columns there are. Null and empty texts and rows without words add nothing; a null language counts as "und";
    repeated rows count as often as they stand there; a language without candidates and an empty table give no rows.
    """
    spark = docs.sparkSession
    with swept(spark) as kept:
        shards = write_shards(docs, shard_bytes)
        counts = written(spark, phrase_counts(shards, least), "phrases")
        ranked = scored(counts, share).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
        first = ranked if top is None else ranked.filter(F.col("rank") <= top)
        n = shards.groupBy("lang").agg(F.sum("words").alias("n"))
        out = written(spark, first.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
        kept.append(out)
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; what collocations says of nulls, empty and repeated rows, ties and empty tables holds."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w CROSS JOIN (VALUES (1), (2), (3)) AS s(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.k, c.phrase, a, x.f AS l, y.f AS r, a * a * 1000000 // (x.f * y.f) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY a * a * 1000000 // (x.f * y.f), cut) AS place
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')),
t AS (SELECT lang, string_split(phrase, ' ') AS w, f FROM f WHERE k = 3),
i AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM t UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM t) GROUP BY lang, phrase),
q AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank
  FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase AND s.k = 2 WHERE place = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM q JOIN n USING (lang) WHERE rank <= 2000
"""
