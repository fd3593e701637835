"""Collocations against counts made one by one."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from silvatide.llm import collocation
from silvatide.llm.collocation import Grams, collocations, packed, unpacked

SCHEMA = "lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, share=(50, 100), top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    frequent = {p: a for p, a in f.items() if a >= least}
    held = Counter()
    for (lang, p), a in frequent.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                held[lang, q] = max(held[lang, q], a)
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and not (held[lang, p] and share[1] * held[lang, p] >= share[0] * a):
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def said(spark, rows, **how):
    return sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect())


def prose(seed, n, words=30):
    r = random.Random(seed)
    pool = [r.choice("abcdeÄß") * r.randint(1, 4) + r.choice(["", "-", "'s", "x" * 70]) for _ in range(words)]
    ends = ["", ".", ", ", " ;", "\n", "\r\n", "\x0b", "\t", "  ", "! ?"]
    return " ".join(r.choice(pool) + r.choice(ends if r.random() < 0.2 else [""]) for _ in range(n))


CASES = {
    "prose": [(r, prose(k, 300)) for k, r in enumerate(["en", "de", None, "en", "und", "en"])],
    # Overlaps, words that hold other words, repeated rows, one phrase in all texts, a long piece and words of other letters.
    "overlaps": [("en", "the the the the the the the the the the the the THE")] + [("en", "bathe the lathe, the lathe bathe")] * 12 + [("fr", "ÉCOLE été École Été")] * 11,
    "long piece": [("en", " ".join(f"w{i % 7} v" for i in range(6000)))],
    "edges": [(None, None), ("en", ""), ("en", " \t.,;\n"), ("de", "a"), ("", "x y " * 20), ("en", "nul \x00 nul \x00 " * 10), ("en", "nbsp word a\x1cb " * 12)],
    "none frequent": [("en", "a b c d e f")],
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("shard_bytes", [60, 4 << 20])
def test_collocations(spark, name, shard_bytes):
    assert said(spark, CASES[name], shard_bytes=shard_bytes) == brute(CASES[name])


def test_parameters(spark):
    rows = CASES["prose"]
    assert said(spark, rows, least=4, share=(80, 100), top=7) == brute(rows, 4, (80, 100), 7)
    assert said(spark, rows, least=1) == brute(rows, 1, top=2000)
    with pytest.raises(ValueError):
        collocations(spark.createDataFrame(rows, SCHEMA), least=0)


def test_cells_that_collide(spark, monkeypatch):
    """Upper bounds only let more candidates in; with cells of 8 bits nearly every phrase is one."""
    rows = CASES["prose"]
    small = [(r, t[:800]) for r, t in rows]
    monkeypatch.setattr(collocation, "CELL_BITS", 8)
    for lang, text in small[:2]:
        g = Grams(lang, b"\n " + b" \n ".join(collocation.normalised(text.encode())[0]) + b" \n")
        assert g.cell.max() < 256
    g = Grams("en", b"\n a b \n b c \n")
    g.hash[:] = 5  # all phrases share one hash: bytes tell them apart
    g.cell[:] = 0
    assert g.candidates(np.array([0], np.uint64)) == [b"a", b"a b", b"b", b"b c", b"c"]


def test_many_words():
    """Numbers of three words that pass 64 bits together are made dense on the way."""
    g = Grams("en", b"\n a b c \n b c \n a b c \n")
    cells, before = np.unique(g.cell), g.candidates(np.unique(g.cell))
    assert before == [b"a", b"a b", b"a b c", b"b", b"b c", b"c"]
    g.vocab += [b"d"] * (3 << 20)
    assert g.candidates(cells) == before


def test_spellings(monkeypatch):
    """In any chain of spellings, each of them and each two in a row are found at their own places alone."""
    monkeypatch.setattr(collocation, "LETTERS", 2)
    words = collocation.spellings(30)
    assert len(set(words)) == 30 and [len(w) for w in words[:6]] == [1, 1, 2, 2, 2, 2] and "\0" not in "".join(words)
    r = random.Random(5)
    row = [r.randrange(30) for _ in range(3000)]
    text = "".join(words[x] for x in row)
    for k in (1, 2):
        put = Counter(tuple(row[i : i + k]) for i in range(len(row) - k + 1))
        for p, n in put.items():
            assert sum(1 for _ in re.finditer(f"(?={re.escape(''.join(words[x] for x in p))})", text)) == n


def test_letters():
    """What stands in a shard most often gets the shortest spelling; the scanned text is shorter than the words."""
    text = "\n " + " \n ".join(" ".join(f"word{min(i % 7, i % 200)}" for i in range(600)) for _ in range(3)) + " \n"
    g = Grams("en", text.encode())
    used = np.unique(np.concatenate([x.ravel() for x in g.among(np.unique(g.cell))]))
    letters = g.letters(used)
    often = np.bincount(g.row)
    assert letters[0] == "\0" and len(set(letters)) == len(letters) == len(used) + 1
    assert [often[g.vocab.index(w)] for w in sorted(g.vocab[1:], key=lambda w: letters[g.vocab.index(w)])] == sorted(often[1:], reverse=True)
    assert sum(len(letters[x]) for x in g.row.tolist()) < len(text) / 4


def test_packed():
    cells = np.array([0, 1, 255, 256, 1 << 30, (1 << 40) - 1], np.uint64)
    assert (unpacked(packed(cells)) == cells).all() and len(packed(cells)) == 30 and not len(unpacked(b""))


def test_exact_scores(spark):
    """Counts of 15 digits: products of more than 64 bits."""
    a, l, r = 123456789012345, 234567890123456, 345678901234567
    counts = spark.createDataFrame([("en", "x y", a), ("en", "x", l), ("en", "y", r)], "lang string, phrase string, f bigint")
    assert [x.score for x in collocation.scored(counts).collect()] == [1000000 * a * a // (l * r)]


def test_clashing_columns_and_empty(spark):
    rows = CASES["prose"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit(1), "n": F.lit("x"), "words": F.lit(None), "rank": F.lit(2)})
    assert sorted(tuple(r) for r in collocations(df.select("n", "text", "shard", "words", "lang", "rank")).collect()) == brute(rows)
    none = collocations(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_oracle_ties():
    rows = CASES["prose"] + CASES["overlaps"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(collocation.ORACLE_SQL).fetchall()) == brute(rows)
