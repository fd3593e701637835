"""License scans by template markup.

A template is licence wording with two kinds of region, in the public SPDX
template markup: ``<<beginOptional>>words<<endOptional>>`` may be missing (such regions
may lie inside each other), and ``<<var;max=N>>`` stands for up to N words of any kind.
Other markup, and regions that do not match up, are errors. Templates are compiled
to token automata (optional regions become skips, replaceable ones counted
gaps). A text is accepted where all mandatory words stand exactly, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import arrow_map, table
from .textops import ALNUM, Words, chunks, column, hash_words, text_buffer


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


# The phrases and labels that the contract states, without free regions.
BASE_TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
# Wording of public licences and notices, with their optional and replaceable regions.
OWN_TEMPLATES = (
    Template("gpl-3", "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<var;max=8>> version 3"),
    Template("gpl-2", "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<var;max=8>> version 2"),
    Template("lgpl", "gnu <<var;max=1>> lesser general public license"),
    Template("agpl-3", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by", "creative commons attribution <<var;max=4>> license"),
    Template("cc0", "cc0 1 0 universal"),
    Template("public-domain", "released into the public domain"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


class Automaton:
    """One template. States are positions in its words; a state may be skipped (optional) or wait (a gap)."""

    def __init__(self, t: Template):
        self.label, self.base = t.label, t.base
        self.words: list[bytes] = []
        self.skip: dict[int, set[int]] = {}  # before this word optional regions begin; they end before those
        self.gap: dict[int, int] = {}  # before this word up to so many others may stand
        opened: list[int] = []
        for mark, word in re.findall(r"(<<.*?>>|<<|>>)|([^\s<>]+)", t.markup):
            if mark == "<<beginOptional>>":
                opened.append(len(self.words))
            elif mark == "<<endOptional>>":
                if not opened or opened[-1] == len(self.words):
                    raise ValueError(f"{t.label}: an optional region that was not opened, or is empty")
                self.skip.setdefault(opened.pop(), set()).add(len(self.words))
            elif m := re.fullmatch(r"<<var;max=([0-9]+)>>", mark):
                self.gap[len(self.words)] = self.gap.get(len(self.words), 0) + int(m[1])
            elif mark:
                raise ValueError(f"{t.label}: unknown markup {mark}")
            else:
                self.words.append(word.encode())
        if opened:
            raise ValueError(f"{t.label}: an optional region that is not closed")
        optional = {i for a, ends in self.skip.items() for b in ends for i in range(a, b)}
        self.mandatory = len(self.words) - len(optional)
        if not self.mandatory:
            raise ValueError(f"{t.label}: no mandatory word")
        self.number: list[int] = []

    def numbered(self, vocabulary: dict[bytes, int]) -> Automaton:
        self.number = [vocabulary[w] for w in self.words]
        return self

    def starts(self) -> set[int]:
        """Numbers of the words a match can begin with."""
        return {self.number[s] for s, _ in self._closed({(0, 0)}) if s < len(self.words)}

    def _closed(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, seen = list(states), set(states)
        while todo:
            s, _ = todo.pop()
            for end in self.skip.get(s, ()):
                if (end, 0) not in seen:
                    seen.add((end, 0))
                    todo.append((end, 0))
        return seen

    def accepts(self, v: Sequence[int], at: int, stop: int) -> bool:
        """Whether a match starts at word `at` of the numbers v; states are (next word, words already taken by the gap before it)."""
        states = self._closed({(0, 0)})
        end = len(self.words)
        first = True
        while at < stop:
            word, moved = int(v[at]), set()
            for s, used in states:
                if s < end and self.number[s] == word:
                    moved.add((s + 1, 0))
                if not first and s < end and used < self.gap.get(s, 0):
                    moved.add((s, used + 1))
            states = self._closed(moved)
            if any(s == end for s, _ in states):
                return True
            if not states:
                return False
            at, first = at + 1, False
        return False


class Scanner:
    def __init__(self, templates: Sequence[Template]):
        automata = [Automaton(t) for t in templates]
        words = sorted({w for a in automata for w in a.words})
        h = hash_words(words)
        order = np.argsort(h)
        self.words, self.hashes = [words[k] for k in order], h[order]
        number = {w: k + 1 for k, w in enumerate(self.words)}  # 0: any other word
        self.automata = [a.numbered(number) for a in automata]
        self.by_number = [[a for a in self.automata if k in a.starts()] for k in range(len(self.words) + 1)]
        self.begins = np.array([bool(x) for x in self.by_number])
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, w: Words) -> np.ndarray:
        """The number of each word in the templates' vocabulary: found by hash, decided by its bytes."""
        h, out = w.hashes(), np.zeros(len(w), np.int64)
        if len(self.words):
            at = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.words) - 1)
            ok = self.hashes[slot] == h[at]
            at, slot = at[ok], slot[ok]
            out[at] = np.where(w.spelled(at, self.words, slot), slot + 1, 0)
        return out

    def scan(self, w: Words) -> tuple[np.ndarray, ...]:
        """Of each row: number of base places, first and last start (-1: none), base labels, labels, mandatory words of the longest match."""
        rows = len(w.first) - 1
        n_base = np.zeros(rows, np.int64)
        first, last = np.full(rows, -1), np.full(rows, -1)
        base: list[set[str]] = [set() for _ in range(rows)]
        own: list[set[str]] = [set() for _ in range(rows)]
        longest = np.zeros(rows, np.int64)
        v = self.numbers(w)
        places = np.flatnonzero(self.begins[v]) if len(v) else np.zeros(0, np.int64)
        row = np.searchsorted(w.first, places, "right") - 1
        for p, r in zip(places.tolist(), row.tolist(), strict=True):
            stop = int(w.first[r + 1])
            for a in self.by_number[v[p]]:
                # No free region after the first word: its second word must follow at once.
                if 1 not in a.gap and 1 not in a.skip and 0 not in a.skip and len(a.number) > 1 and (p + 1 >= stop or int(v[p + 1]) != a.number[1]):
                    continue
                if a.accepts(v, p, stop):
                    own[r].add(a.label)
                    longest[r] = max(longest[r], a.mandatory)
                    if a.base:
                        base[r].add(a.label)
                        at = p - int(w.first[r])
                        n_base[r] += 1
                        first[r] = at if first[r] < 0 else min(first[r], at)
                        last[r] = max(last[r], at)
        return n_base, first, last, base, own, longest


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = BASE_TEMPLATES + OWN_TEMPLATES) -> DataFrame:
    """One row for each text: n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 0 without a match, else m / (m + 3) for the m mandatory words of the longest accepted template: the longer
    the exact wording, the surer. A null or empty text has no words, null first_word and last_word, empty labels and
    score 0. Repeated rows are each scanned; an empty table gives no rows; other columns are ignored.
    """
    scanner = Scanner(templates)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "id")
            data, off = text_buffer(column(b, "text"))
            for i, j in chunks(off):
                w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
                n_base, first, last, base, own, longest = scanner.scan(w)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array(n_base, pa.int64()),
                        pa.array(first, pa.int64(), mask=first < 0),
                        pa.array(last, pa.int64(), mask=last < 0),
                        pa.array([",".join(sorted(x)) for x in base], pa.string()),
                        pa.array([",".join(sorted(x)) for x in own], pa.string()),
                        pa.array(longest / (longest + 3.0), pa.float64()),
                    ],
                    names=names,
                )

    return arrow_map(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; what scan_licenses says of nulls, empty and repeated rows and empty tables holds."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The templates as patterns over " word word ..."; a gap is up to N free words."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cases, sizes = [], []
    for t in BASE_TEMPLATES + OWN_TEMPLATES:
        a, pattern = Automaton(t), ""
        for i, word in enumerate(a.words):
            pattern += "(?:" * len(a.skip.get(i, ()))
            if i in a.gap:
                pattern += f"(?: [^ ]+){{0,{a.gap[i]}}}"
            pattern += " " + word.decode()
            pattern += ")?" * sum(i + 1 in ends for ends in a.skip.values())
        hit = f"regexp_matches(norm, '{pattern} ')"
        cases.append(f"CASE WHEN {hit} THEN '{t.label}' END")
        sizes.append(f"CASE WHEN {hit} THEN {a.mandatory} ELSE 0 END")
    places = " OR ".join("(" + " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(t.markup.split())) + ")" for t in BASE_TEMPLATES)
    base = ", ".join(f"CASE WHEN contains(norm, ' {t.markup} ') THEN '{t.label}' END" for t in BASE_TEMPLATES)
    join = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{x}], lambda v: v IS NOT NULL))), ','), '')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS norm FROM d),
p AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: {places}) AS places FROM n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word,
       CAST(list_max(places) - 1 AS BIGINT) AS last_word, {join(base)} AS base_labels, {join(', '.join(cases))} AS labels,
       greatest({', '.join(sizes)}) / (greatest({', '.join(sizes)}) + 3.0) AS score
FROM p
"""


ORACLE_SQL = _oracle()
