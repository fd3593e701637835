"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvatide.llm import bitsliced, decontaminate, html_extract, induced, license_scan, mixing, partenum, succinct, suffix_dedup, textops, token_output, toxicity, url_filter
from silvatide.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, source string, n_words long, score double, h long"


def words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, s, 7, 0.5, 1) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# Primitives
def test_words_and_shingles():
    texts = ["Ab c\x00d-É", "", None, "x" * 5000 + " y", "12 3b"]
    data, off = textops.text_buffer(pa.array(texts, pa.string()))
    w = textops.Words(data, off)
    flat = [w.code[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert [flat[w.first[k] : w.first[k + 1]] for k in range(5)] == [words(t) for t in texts]
    assert (w.hashes() == textops.hash_words([x.encode() for x in flat])).all()
    h, b = textops.shingles(w.hashes(), w.first, 3)
    assert np.diff(b).tolist() == [2, 0, 0, 1, 1]
    assert h[0] != h[1]


@pytest.mark.parametrize("seed", range(30))
def test_suffix_sorting_and_fm_index(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(1, rng.integers(2, 6), rng.integers(1, 80))
    t = np.append(seq, 0).astype(np.uint16)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert induced.sort_suffixes(t, 64).tolist() == want  # queues that spill at once
    assert succinct.suffix_array(t.astype(np.int64)).tolist() == want
    fm = succinct.FMIndex(seq, sample=3)
    p = rng.integers(1, 6, (9, 2))
    lo, hi = fm.ranges(p.ravel(), np.arange(9) * 2, 2)
    for k in range(9):
        at = sorted(fm.locate(np.arange(lo[k], hi[k])).tolist())
        assert at == [i for i in range(len(seq) - 1) if seq[i] == p[k, 0] and seq[i + 1] == p[k, 1]]


def test_wavelet_matrix_round_trip():
    v = np.random.default_rng(0).integers(0, 50000, 3001).astype(np.uint16)
    w = succinct.WaveletMatrix.load(succinct.WaveletMatrix.of(v, 16).dump())
    assert (w.decode() == v).all() and (w.access(np.arange(3001)) == v).all()
    x = int(v[17])
    assert w.count(x) == (v == x).sum() and w.occurrences(x).tolist() == np.flatnonzero(v == x).tolist()
    assert len(succinct.WaveletMatrix.load(succinct.WaveletMatrix.of(v[:0], 16).dump()).decode()) == 0
    # Ranks and selects of a file are those of memory, past several superblocks and samples.
    v = np.random.default_rng(1).integers(0, 3, 40000).astype(np.uint16)
    a = succinct.WaveletMatrix.of(v, 2)
    b = succinct.WaveletMatrix.load(a.dump())
    at = np.random.default_rng(2).integers(0, 40001, 500)
    for x in range(3):
        assert (b.rank(np.full(500, x), at) == a.rank(np.full(500, x), at)).all() and (b.occurrences(x) == np.flatnonzero(v == x)).all()


@pytest.mark.parametrize("n", [0, 1, 64, 4096, 30000])
def test_directory_asks_for_samples_only(monkeypatch, n):
    bits = np.random.default_rng(n).random(n) < 0.4
    v = succinct.BitVector.of(bits)
    monkeypatch.setattr(succinct.BitVector, "bits", None)  # the plane is not unpacked
    _, zeros, ones = v.directory()
    assert zeros.tolist() == np.flatnonzero(~bits)[:: succinct.SAMPLE].tolist() and ones.tolist() == np.flatnonzero(bits)[:: succinct.SAMPLE].tolist()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + k, 501 + k) for k in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# 1
def test_licenses(spark):
    texts = [
        "Under the MIT license, under the MIT License. cc by nc",
        "under the terms of the GNU General Public License as published, version 3",
        "under the gnu general public license version 3",
        "under the gnu general public license one two three four five six seven eight nine version 3",
        "gnu affero general public license",
        None,
        "",
        "under the mit",
        "license " * 3000 + "apache license version 2",
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 0, 8, "cc-by-nc,mit")
    assert [got[k].labels for k in range(1, 5)] == ["gpl-3", "gpl-3", "", "agpl-3"]
    assert [(got[k].n_words, got[k].first_word, got[k].labels, got[k].score) for k in (5, 6, 7)] == [(0, None, "", 0.0), (0, None, "", 0.0), (3, None, "", 0.0)]
    assert (got[8].first_word, got[8].labels) == (3000, "apache-2")
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0
    again = license_scan.scan_licenses(docs(spark, [texts[0], texts[0]], [1, 1]).withColumnRenamed("doc_id", "a.b"), "a.b").collect()
    assert len(again) == 2 and again[0] == again[1]
    nested = license_scan.Template("n", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>> four<<endOptional>> <<var;max=1>> five")
    said = ["one five", "one two four five", "one two three four five", "one two three four x five", "one two three five", "one two x y five", "one x five"]
    found = license_scan.scan_licenses(docs(spark, said), templates=[nested]).collect()
    assert [r.labels for r in sorted(found, key=lambda r: r.doc_id)] == ["n", "n", "n", "n", "", "", "n"]
    for markup in ("a <<beginOptional>>b", "a <<endOptional>> b", "a <<beginOptional>><<endOptional>> b", "a <<var>> b", "a << b", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            license_scan.Automaton(license_scan.Template("bad", markup))


# 2
@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n two <b>three</b><p>Four<div class='ad'>Buy</div></article><footer>x</footer>", "A & B\nOne two three\nFour"),
        ("<main><p>Text one &lt;x&gt;<br>more<aside>no</aside><section id='comments'><p>Great post</p></section><form>Name</form></main>", "Text one <x> more"),
        ("<article><script>var a='</p><p>no</p>';</script><!-- <p>no</p> --><p>Yes</p></article>", "Yes"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>Body</p></article>", "Title\nBody"),
        ("<article><p>cut off <b>here</b> <a hre", "cut off here"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page, html_extract.Tree()) == text


def test_figures_of_the_article_stay():
    page = "<article><p>Before it</p><figure><table><tr><td>12 cells</td></tr></table><figcaption>A caption of the figure</figcaption></figure><p>After it</p></article>"
    assert html_extract.main_text(page, html_extract.Tree()).split("\n") == ["Before it", "12 cells", "A caption of the figure", "After it"]


LONG = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article><p>{LONG}</p><figure><img src=x><figcaption>A caption</figcaption></figure><math><mi>x</mi></math></article>", f"{LONG}\nA caption\nx"),
        (f"<article><p class=copyright>{LONG}</p><p class='menu'>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<div class='social history'><p>{LONG}</p></div>", LONG),
        ("<p>Is it so?</p><p>Yes.</p><p>No.</p><p>That is all there is to say</p>", "Is it so?\nYes.\nNo.\nThat is all there is to say"),
        (f"<ul><li><a href=/>Home</a><li><a href=/a>About</a></ul><p>{LONG}</p><div>Copyright 2024</div>", LONG),
        (f"<article><p>{LONG}</p><div class='share'><a>Tweet</a><a>Mail</a></div><p><a href=x>See this</a></p><p>End</p></article>", f"{LONG}\nSee this\nEnd"),
        (f"<article><p>{LONG}</p></article><p>© 2024 All rights</p>", LONG),
        ("<article><p>a <a href='x'>b <a href=\"y>z\">c</a> d</p></article>", "a b c d"),
        ("<article><p title=\"a > b\" data-x='<p>'>one</p></article>", "one"),
        ("<article><p>x &lt;b&gt; &amp;amp; &#233;&nbsp;y</p></article>", "x <b> &amp; é y"),
    ],
)
def test_doubtful_markup(page, text):
    assert html_extract.main_text(page, html_extract.Tree()) == text


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<b><p>x", "</x>", "<a>", "<li>x", "<!--", "<script>", '<a class="', "<", "<table><td>", "</b>", "<![CDATA[", "<p class="])
def test_hostile_pages_take_linear_time(unit):
    import time

    tree, took = html_extract.Tree(), []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html_extract.main_text(unit * n, tree)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.05)


def test_neighbours_and_links_decide():
    """The same block is kept or dropped by what stands around it and how much of it is link."""
    tree = html_extract.Tree()
    around = lambda before, block, after: html_extract.main_text(f"<div>{before}</div><div>{block}</div><div>{after}</div>", tree)
    links = "<a href=x>one</a> <a href=y>two</a>"
    assert "six words stand in this block" in around(LONG, "six words stand in this block", LONG)
    assert "six words" not in around(links, "six words stand in this block", links)
    assert "linked" not in around(LONG, "<a href=x>linked words that go on for a while</a>", LONG)


NEWS = " ".join(f"word{k}" for k in range(60))


@pytest.mark.parametrize(
    "page,text",
    [
        # A paragraph that is one link, after a long paragraph of the article.
        (f"<article><p>{NEWS}</p><p><a href=x>The full report is here</a></p></article>", f"{NEWS}\nThe full report is here"),
        (f"<article><p>{NEWS}</p><ul><li><a href=x>One</a></li><li><a href=y>Two of them</a></li></ul><p>End.</p></article>", f"{NEWS}\nOne\nTwo of them\nEnd."),
        # A doubtful class on short prose, before a short paragraph.
        ("<article><p class='legal'>So it was.</p><p>And so it stayed.</p></article>", "So it was.\nAnd so it stayed."),
        # Class words that say something else than the boilerplate word in them.
        (f"<article><p>{NEWS}</p><div class='share-price'>It rose to nine today</div><p>So they say.</p></article>", f"{NEWS}\nIt rose to nine today\nSo they say."),
        (f"<article><section class='related-work'><h2>Related work</h2><p>{NEWS}</p><p>Few did.</p></section></article>", f"Related work\n{NEWS}\nFew did."),
        # The same words and no others: dropped, prose or not.
        (f"<article><p>One.</p><div class='share-buttons'><p>{NEWS}</p></div><section class='related-posts'><p>{NEWS}</p></section><div class='comment-list'><p>{NEWS}</p></div><p>Two.</p></article>", "One.\nTwo."),
        # Long text before links outside the article.
        (f"<div>{NEWS}</div><div><a href=x>a</a> <a href=y>b</a></div><article><p>One.</p></article><p>{NEWS}</p><ul><li><a href=x>c</a></li></ul>", "One."),
        # Worded like a notice: dropped if short and in no paragraph of the article.
        (f"<article><p>One.</p><div>We use cookies to serve you.</div><p>All rights reserved.</p><p>Copyright law says: {NEWS}</p></article>", f"One.\nAll rights reserved.\nCopyright law says: {NEWS}"),
    ],
)
def test_the_article_is_kept_whole_and_nothing_else(page, text):
    assert html_extract.main_text(page, html_extract.Tree()) == text


def test_markup_decides_where_it_is_plain():
    """Whatever words and links a block and its neighbours hold: containers of boilerplate go, a main container keeps what no class or wording makes doubtful, outside of it nothing is kept."""
    tree = html_extract.Tree()
    for around in itertools.product([1, 3, 8, 40, 200], [0, 0.3, 0.6, 1], [0, 2, 40], [0, 1], [0, 2, 40], [0, 1], [0, 1], [0, 1]):
        of = lambda boiler, doubtful, notice, place, a=around: tree.predict((*a[:6], boiler, doubtful, notice, place, *a[6:]))
        assert of(0, 0, 0, 1) and not of(1, 0, 0, 1) and not of(1, 0, 0, 0)
        assert not any(of(0, d, n, -1) for d in (0, 1) for n in (0, 1))
        if around[1] == 0 and around[6]:  # paragraphs of the article without a link, whatever their class or wording
            assert of(0, 1, 0, 1) and of(0, 0, 1, 1)


def test_labels_are_learned():
    rows = html_extract.labelled()
    tree = html_extract.Tree(rows)
    assert len(rows) > 180 and sum(tree.predict(x) != y for x, y in rows) <= 0.03 * len(rows)
    assert all(len(x) == len(html_extract.FEATURES) for x, _ in rows)


def _plain_extract(page):
    """An independent reading of well-formed pages by another parser: text of the article's block elements, without what is no main text by its tag or whole class."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.out, self.now = [], [], ""

        def flush(self):
            if self.now.strip():
                self.out.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag not in ("a", "b", "em"):
                self.flush()
            self.stack.append((tag, dict(attrs).get("class")))

        def handle_endtag(self, tag):
            if tag not in ("a", "b", "em"):
                self.flush()
            self.stack.pop()

        def handle_data(self, data):
            inside = [t for t, _ in self.stack]
            gone = any(t in ("nav", "aside", "form", "footer", "script", "style") or c in ("ad", "share-buttons", "comments", "newsletter") for t, c in self.stack)
            if ("article" in inside or "main" in inside) and not gone:
                self.now += data

    p = P()
    p.feed(page)
    p.flush()
    return "\n".join(p.out)


def test_pages_of_other_markup_against_another_parser():
    rng = np.random.default_rng(5)
    prose = lambda: " ".join(f"w{rng.integers(99)}" for _ in range(int(rng.choice([1, 3, 9, 30, 80]))))
    link = lambda: f"<a href='/{rng.integers(99)}'>{prose()}</a>"
    inline = lambda: str(rng.choice([prose(), f"{prose()} {link()} {prose()}", link(), f"<b>{prose()}</b> &amp; {prose()}", f"<em>{link()}</em>"]))

    def inner(depth=0):
        kind = rng.integers(9 if depth < 3 else 5)
        if kind < 3:
            return f"<p>{inline()}</p>"
        if kind == 3:
            return f"<h2>{inline()}</h2>"
        if kind == 4:
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(3)) + "</ul>"
        within = "".join(inner(depth + 1) for _ in range(3))
        if kind == 5:
            return f"<section class='chapter'>{within}</section>"
        if kind == 6:
            return f"<table><tbody><tr><td>{inline()}</td><td>{inline()}</td></tr></tbody></table>"
        if kind == 7:
            return f"<div class='{rng.choice(['ad', 'share-buttons', 'comments', 'newsletter'])}'>{within}</div>"
        return f"<blockquote>{within}</blockquote>" if depth else f"<aside>{within}</aside>"

    tree = html_extract.Tree()
    for k in range(150):
        top = ("article", "main")[k % 2]
        outside = "".join(f"<div class='teaser'>{inline()}</div>" for _ in range(3))
        page = f"<html><body><nav>{link()}{link()}</nav>{outside}<{top}>{''.join(inner() for _ in range(8))}</{top}>{outside}<footer>{prose()}</footer></body></html>"
        assert html_extract.main_text(page, tree) == _plain_extract(page), page


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", "clash"), (1, "u", None, "x"), (None, None, "<article>" + "<p>w</p>" * 3000 + "</article>", "")], "page_id long, url string, html string, text string")
    got = rows(html_extract.extract_text(df), "page_id", "url", "n_chars")
    assert got == sorted([(1, "u", 1), (1, "u", 0), (None, None, 5999)], key=repr)
    assert html_extract.extract_text(df.limit(0)).count() == 0


# 3
def test_contamination_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate((13, 20, 4, 15, 13))] + [(5, None), (6, "--"), (7, "w1 w2 w3 w4")]
    items.append((8, items[0][1]))
    texts = [None, "", "w1 w2"]
    for _ in range(60):
        t = [rng.choice(vocab + ["other"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(t))
            t[at:at] = items[rng.choice((0, 1, 3))][1].split()
        texts.append(" ".join(t).upper())
    texts.append(texts[5])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.find_contamination(docs(spark, texts), bench).collect():
        got[r.doc_id] = (r.n_words, r.n_hit, r["items"], [(s.start, s.end) for s in r.spans])
    for k, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for i, x in items:
            p = words(x)
            n = min(13, len(p))
            for a in range(len(p) - n + 1 if p else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == p[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(i))
        assert got[k][:3] == (len(w), len(hit), sorted(found))
        assert set(x for a, b in got[k][3] for x in range(a, b)) == hit
    blocks = decontaminate.find_contamination(docs(spark, texts), bench, block_bytes=20)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in blocks.collect()} == {k: v[:3] for k, v in got.items()}
    none = decontaminate.find_contamination(docs(spark, texts), bench.limit(0))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(texts)
    assert decontaminate.find_contamination(docs(spark, []), bench).count() == 0


def test_contamination_keeps_every_row_over_several_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(13))) for k in range(4)]
    other = " ".join(f"z{j}" for j in range(13))
    texts = [items[0][1], items[1][1], other, other, items[0][1] + " " + items[3][1], items[2][1], other]
    ids = [1, 1, 1, 1, 2, None, None]
    bench, names = spark.createDataFrame(items, "item_id long, text string"), ("doc_id", "n_words", "n_hit", "items", "spans")
    df = docs(spark, texts, ids)
    got = rows(decontaminate.find_contamination(df, bench, block_bytes=20), *names)
    assert got == rows(decontaminate.find_contamination(df, bench), *names)
    assert sorted((r[2], r[3]) for r in got) == [(0, [])] * 3 + [(13, ["0"]), (13, ["1"]), (13, ["2"]), (26, ["0", "3"])]
    whole = decontaminate.find_contamination
    monkeypatch.setattr(decontaminate, "find_contamination", lambda *a, **b: whole(*a, block_bytes=20, **b))
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and rows(left, "doc_id", "text") == sorted([(1, other), (1, other), (None, other)], key=repr)


# 4
def test_url_rules(spark):
    urls = [None, "", "x", "http://A.example.NET/en/1?q=/de/", "https://example.net", "http://a.net/x#y", "http://e.example.com/de/1", "http://b.org/fr/", "http://www.spam-farm.example.org/en/1", "http://x.com/a/setup.exe", "http://é.net/" + "p" * 9000]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert [(got[k].rule, got[k].verdict) for k in range(11)] == [
        (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block"), (None, "block"), ("net/", "block"),
    ]
    assert (got[3].host, got[3].path) == ("a.example.net", "/en/1")


def test_url_edges(spark):
    df = spark.createDataFrame([(1, "http://a.net/" + "x" * 300_000), (1, "http://a.net/" + "x" * 300_000), (2, "HTTP://É.NET/"), (3, "a\n://b\nc.org/fr/x\ny?z")], "`page.id` long, url string")
    got = url_filter.filter_urls(df, "page.id").collect()
    assert [r.rule for r in got] == ["net/", "net/", "net/", "org/fr/"] and (got[2].host, got[3].host, got[3].path) == ("É.net", "b\nc.org", "/fr/x\ny")
    assert url_filter.filter_urls(df.limit(0), "page.id").count() == 0


def test_automaton_against_patterns():
    rng = random.Random(4)
    patterns = ["".join(rng.choice(["a", "b", "/", "*", "**", "."]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = url_filter.ShiftAnd(patterns).match([t.encode() for t in texts])

    def regex(p):
        return re.compile("".join({"**": ".*", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", p)), re.S)

    assert got.tolist() == [[regex(p).fullmatch(t) is not None for p in patterns] for t in texts]


# 5
def brute_components(texts, k, share):
    sets = []
    for t in texts:
        w = words(t, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and len(sets[i] & sets[j]) >= share * u:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))]


@pytest.mark.parametrize("k,share", [(4, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_near_duplicates_against_brute_force(spark, k, share):
    rng = random.Random(k)
    texts = [None, "", "a", "a", "a b", "A B", "a b c", "x " * 400]
    base = [[f"w{rng.randrange(900)}" for _ in range(n)] for n in (8, 20, 40, 40, 80, 150)]
    for b in base:
        for _ in range(9):
            t = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 20))):
                t[rng.randrange(len(t))] = f"v{rng.randrange(99)}"
            texts.append(" ".join(t))
    common = " ".join(base[3])  # a passage that documents of many sizes share
    texts += [common + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randint(2, 30))) for _ in range(25)]
    texts += [texts[12]] * 6
    got = rows(partenum.near_duplicates(docs(spark, texts), k, share), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(texts, k, share), key=repr)


def test_near_duplicates_edges(spark):
    assert partenum.near_duplicates(docs(spark, [])).count() == 0
    got = partenum.near_duplicates(docs(spark, ["a b c d e f", "a b c d e f", None], [3, None, None]))
    assert rows(got, "doc_id", "component_id") == sorted([(3, 3), (None, None), (None, None)], key=repr)
    kept = partenum.keep_one(docs(spark, ["a b c d e f", "a b c d e f", "z", "z", "q"], [5, 4, None, 9, 9]))
    # The two texts of id 9 are documents of their own, which do not link.
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect()) == [(-1, "z"), (4, "a b c d e f"), (9, "q"), (9, "z")]


def test_keep_one_takes_an_id_and_a_text_as_a_document(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    texts = [long, "b c d e f g", long, long, "", "", None, None, "b c d e f g", "x y z u v w"]
    ids = [7, 7, 7, 3, 5, 5, 5, 5, 7, 3]
    kept = partenum.keep_one(docs(spark, texts, ids)).collect()
    # The long text stays with id 3; of id 7 the other text stays, once; of id 5 one row without words for each text; id 3 keeps both of its texts.
    want = [(3, long), (3, "x y z u v w"), (5, None), (5, ""), (7, "b c d e f g")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)
    # A link by way of another text of the id no longer joins what does not link.
    apart = partenum.keep_one(docs(spark, [long, "p q r s t u", "p q r s t u", "k l m n o p"], [1, 1, 2, 2])).collect()
    assert sorted((r.doc_id, r.text) for r in apart) == sorted([(1, long), (1, "p q r s t u"), (2, "k l m n o p")])


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    bands = partenum.Bands(Fraction(85, 100))
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(a) // 7 + 1)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)]))
        if len(b) and partenum.linked(a, b, 85, 100):
            assert np.intersect1d(partenum.signatures(a, bands), partenum.signatures(b, bands)).size


@pytest.mark.parametrize("share", [Fraction(85, 100), Fraction(4, 5), Fraction(1, 2)])
@pytest.mark.parametrize("turn", range(len(partenum.CONTENT)))
def test_linked_sets_share_a_signature_in_every_round(share, turn):
    """Differences are put where they hurt most: next to each other, so that few partitions hold them, and spread out."""
    rng = np.random.default_rng(turn)
    bands = partenum.Bands(share)
    for n in [*range(2, 40), 60, 100, 200, 400, 900]:
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        most = (share.denominator - share.numerator) * 2 * len(a) // (share.denominator + share.numerator)
        for take in {0, 1, most // 2, most}:
            for where in ("spread", "together"):
                gone = rng.permutation(len(a))[:take] if where == "spread" else np.arange(min(take, len(a)))
                b = np.unique(np.concatenate([np.delete(a, gone), rng.integers(0, 1 << 64, int(rng.integers(0, most + 1)), dtype=np.uint64)]))
                if len(b) and partenum.linked(a, b, share.numerator, share.denominator):
                    assert np.intersect1d(partenum.signatures(a, bands, turn), partenum.signatures(b, bands, turn)).size


def test_schemes_enumerate_subsets():
    bands = partenum.Bands(Fraction(4, 5))
    for n in (10, 30, 100, 400, 3000):
        s = bands.scheme(bands.band(n), 0)
        assert 0 < s.size < s.inner and s.count == s.outer * len(partenum._subsets(s.inner, s.size)) > s.outer


def test_near_copies_in_large_groups(spark, monkeypatch):
    """Groups that link, groups just below the threshold, and a passage that all share; signatures of many sets go to further rounds."""
    monkeypatch.setattr(partenum, "LARGE", 3)
    monkeypatch.setattr(partenum, "ROWS_AT_ONCE", 64)
    monkeypatch.setattr(partenum, "PAIRS_AT_ONCE", 128)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for change in (1, 4, 9, 14):
        base = [rng.choice(vocabulary) for _ in range(160)]
        for _ in range(14):
            t = list(base)
            for at in rng.sample(range(160), change):
                t[at] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    texts += [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(n))]) for n in (5, 10, 20, 40, 60, 90, 120) for _ in range(4)]
    got = rows(partenum.near_duplicates(docs(spark, texts), 4, Fraction(85, 100)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(texts, 4, Fraction(85, 100)), key=repr)


def test_pairs_are_made_once(spark, monkeypatch):
    """A family of copies of one text, most of them changed too much to link: a pair is not made again for each signature that holds it."""
    monkeypatch.setattr(partenum, "LARGE", 3)
    monkeypatch.setattr(partenum, "PAIRS_AT_ONCE", 64)
    monkeypatch.setattr(partenum, "SPREAD", 1)
    made, was = [], partenum.arrow_map

    def counted(df, f, schema):
        out = was(df, f, schema)
        if "least" in df.columns:
            made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(partenum, "arrow_map", counted)
    rng = random.Random(29)
    base = [f"b{i}" for i in range(900)]
    texts = [" ".join(base)]
    for n in range(60):
        w = list(base)
        for _ in range(5 if n % 10 == 0 else 24):
            w.insert(rng.randrange(len(w)), f"new{rng.random()}")
        texts.append(" ".join(w))
    share = Fraction(4, 5)
    sets = [set(zip(*(words(t, r"\S+")[i:] for i in range(5)), strict=False)) for t in texts]
    component = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            component = [min(component[a], component[b]) if c in (component[a], component[b]) else c for c in component]
    got = rows(partenum.near_duplicates(docs(spark, texts), 5, share), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, len(s), c) for i, (s, c) in enumerate(zip(sets, component, strict=True))), key=repr)
    assert len(set(component)) > 30 and made[-1][1] > 1000 and made[-1][0] < 2 * made[-1][1]


def test_pairs_of_a_large_family_that_does_not_link(spark, monkeypatch):
    """Pair rows do not grow with the square of a family that shares its signatures, and a pair that links is not lost with them."""
    made, was = [], partenum.arrow_map

    def counted(df, f, schema):
        out = was(df, f, schema)
        if "least" in df.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(partenum, "arrow_map", counted)
    rng = random.Random(31)
    base = [f"b{i}" for i in range(900)]

    def changed(words, n):
        w = list(words)
        for _ in range(n):
            w.insert(rng.randrange(len(w)), f"new{rng.random()}")
        return w

    family = [changed(base, 26) for _ in range(100)]
    family += [changed(w, 3) for w in family[40:60]]
    got = {r.doc_id: r.component_id for r in partenum.near_duplicates(docs(spark, [" ".join(w) for w in family])).collect()}
    assert got == {n: n if n < 100 else n - 60 for n in range(120)}
    assert made and sum(made) < 300


def test_long_sketches_bound_differences():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 200, 256, 257, 511, 900, 3000, 40000)]
    sets += [np.sort(np.concatenate([s[: -(len(s) // 9) or None], np.unique(rng.integers(0, 1 << 63, len(s) // 5 + 1).astype(np.uint64))])) for s in sets]
    pairs = list(itertools.product(sets, sets))
    apart = partenum._apart([partenum._long_sketch(a) for a, _ in pairs], [partenum._long_sketch(b) for _, b in pairs])
    true = np.array([len(np.setxor1d(a, b)) for a, b in pairs])
    assert (apart <= true).all() and (apart[true > 0] > 0).all() and (apart[true == 0] == 0).all()


def test_texts_of_ids(spark):
    """The bitmap of hashed ids loses none, negative ids and repeated rows included."""
    ids = [*range(-50, 50), 7, 1 << 40, -(1 << 62)]
    texts = docs(spark, [f"t{n}" for n in range(len(ids))], ids).select("doc_id", "text")
    wanted = spark.createDataFrame([(i,) for i in (-50, -1, 0, 7, 49, 1 << 40, -(1 << 62), 99)], "doc_id long")
    got = partenum._of(texts, wanted)
    assert rows(got, "doc_id", "text") == sorted(((i, f"t{n}") for n, i in enumerate(ids) if i in (-50, -1, 0, 7, 49, 1 << 40, -(1 << 62))), key=repr)
    assert partenum._of(texts, wanted.filter("false")).count() == 0


def test_keep_one_keeps_clashing_columns(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'a b c d e f' AS text, 1 AS _row, map('x', 1) AS n_shingles, 2 AS component_id UNION ALL SELECT 0L, 'A b c d e f', 2, map('y', 2), 3")
    kept = partenum.keep_one(df).collect()
    assert [(r.doc_id, r._row, r.component_id) for r in kept] == [(0, 2, 3)] and partenum.keep_one(df).columns == df.columns


def thue_morse(letters, n=1024):
    out = letters[0]
    while len(out) < n:
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


def test_words_that_a_plain_polynomial_confuses(spark):
    """Complementary Thue-Morse words agree in every polynomial modulo a power of two."""
    a, b = thue_morse("ab"), thue_morse("ba")
    assert len(set(textops.hash_words([x[:n].encode() for x in (a, b) for n in (64, 65, 512, 1024)]).tolist())) == 8
    found = {r.doc_id: r.component_id for r in partenum.near_duplicates(docs(spark, [a, b, a])).collect()}
    assert found == {0: 0, 1: 1, 2: 0}


def test_equal_hashes_do_not_decide(spark, monkeypatch):
    """With a hash that hardly tells words apart, licences, benchmark items and tokens are what they were."""
    texts = ["Under the MIT license, released into the public domain", "mozilla public license 2 0 and some other words here", "cc by nc", "nothing of that kind"]
    items = spark.createDataFrame([("i1", "mozilla public license 2 0"), ("i2", "some other words"), ("i3", "no such words")], "item_id string, text string")
    tok = token_output.Encoder(token_output.tokenizer_path())
    long = ["unbelievable considerations extraordinarily", "considerations misunderstandings unbelievable", thue_morse("ab"), thue_morse("ba")]

    def all_of():
        scanner = license_scan.Scanner(license_scan.BASE_TEMPLATES + license_scan.OWN_TEMPLATES)
        data, off = textops.text_buffer(pa.array(texts))
        w = textops.Words(data, off)
        shard = decontaminate.Shard(decontaminate.Phrases([(r.item_id, r.text) for r in items.collect()]))
        shard.add(pa.RecordBatch.from_arrays([pa.array(range(4))], names=["id"]), w)
        found = shard.search(["id"])
        tok.reset()
        return [x.tolist() if hasattr(x, "tolist") else x for x in scanner.scan(w)], found.column("_n_hit").to_pylist(), found.column("_items").to_pylist(), [x.tolist() for x in tok.encode(long)]

    want = all_of()
    assert want[1][1] == 8 and [len(x) for x in want[2]] == [0, 2, 0, 0]
    assert want[3][0] == [i for t in long for i in tok.whole(t).tolist()]
    few = lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3) * np.uint64(0x5555555555555555)
    for module in (textops, token_output):
        monkeypatch.setattr(module, "hash_spans", few)
    monkeypatch.setattr(token_output, "same_spans", lambda a, x, y, b, p, q: np.array([a[i:j].tobytes() == b[k:m].tobytes() for i, j, k, m in zip(x, y, p, q, strict=True)], bool))
    got = all_of()
    assert got[1:3] == want[1:3]


# 6
def brute_dedup(texts, n=50):
    first, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first.setdefault(b[j : j + n], i) < i:
                gone[j : j + n] = b"\1" * n
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def test_suffix_dedup_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 70, 200, 400)]
    texts = [None, "", "short", "a" * 300, "a" * 120, "é" * 25, "é" * 26]
    for _ in range(70):
        texts.append("".join(rng.choice([text(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[:60]]) for _ in range(rng.randint(1, 5))))
    texts += [texts[20], texts[20] + "x"]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4096)
    got = suffix_dedup.dedup(docs(spark, texts)).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256")
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n", "kept_sha256") == sorted(brute_dedup(texts), key=repr)


def test_suffix_dedup_splits_large_anchors(spark, monkeypatch):
    rng = random.Random(66)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = text(40)  # a very common text between others, so that passages at its edges all differ
    ends = [text(12) for _ in range(6)]
    texts = [text(rng.randint(0, 40)) + rng.choice(ends) + common + rng.choice(ends) + text(rng.randint(0, 40)) for _ in range(150)] + [common + "x" * 9] * 2 + [text(9) + common[:25]]
    sizes, sources = [], suffix_dedup._sources

    def spy(passages):
        sizes.append(passages.groupBy("key" if "key" in passages.columns else "h").count().agg(F.max("count")).first()[0] or 0)
        return sources(passages)

    monkeypatch.setattr(suffix_dedup, "HOT_PASSAGES", 5, raising=False)
    monkeypatch.setattr(suffix_dedup, "_sources", spy)
    got = suffix_dedup.dedup(docs(spark, texts)).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256")
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n", "kept_sha256") == sorted(brute_dedup(texts), key=repr)
    assert sizes and max(sizes) <= 5


def test_induction_goes_on_where_names_are_many(monkeypatch):
    t = np.append(np.random.default_rng(0).integers(1, 200, 60000), 0)
    t[20000:40000] = t[:20000]  # so that names repeat
    want = succinct.suffix_array(t)

    def within(seq):
        assert seq.nbytes < 1 << 16, "sorted in memory beyond the memory given"
        return succinct.suffix_array(seq)

    monkeypatch.setattr(induced, "suffix_array", within)
    assert (induced.sort_suffixes(t, 1 << 16) == want).all()


@pytest.mark.parametrize("seed", range(6))
def test_sources_compare_whole_strings_alone(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    pool = [bytes(rng.integers(97, 99, 80).astype(np.uint8)) for _ in range(4)]
    rows_ = []
    for _ in range(90):
        a, b, k = pool[rng.integers(4)], pool[rng.integers(4)], int(rng.integers(0, 81))
        raw = (a[:k] + b[k:])[int(rng.integers(0, 31)) : 80 - int(rng.integers(0, 31))]
        lo = int(rng.integers(0, 40))
        rows_.append((int(rng.integers(0, 5)), len(rows_), lo, lo + int(rng.integers(0, 9)), raw, int(rng.integers(0, 31))))
    rows_.sort()
    t = pa.table(dict(zip(["h", "passage", "lo", "hi", "bytes", "left"], map(list, zip(*rows_, strict=True)), strict=True)))
    held, compared, reaches = [], [], suffix_dedup.common_prefix_reaches
    monkeypatch.setattr(suffix_dedup, "arrow_map", lambda df, run, schema: held.append(run))
    monkeypatch.setattr(suffix_dedup, "common_prefix_reaches", lambda seq, sa, n: compared.append(len(sa)) or reaches(seq, sa, n))
    suffix_dedup._sources(None)
    got = {}
    for b in held[0](iter(t.to_batches())):
        for r in b.to_pylist():
            for x in range(r["begin"], r["end"] - 49):
                assert got.setdefault((r["passage"], x), r["source"]) == r["source"]
    least = {}
    for _, _, lo, _, raw, _ in rows_:
        for x in range(len(raw) - 49):
            least[raw[x : x + 50]] = min(lo, least.get(raw[x : x + 50], lo))
    want = {(p, x - left): least[raw[x : x + 50]] for _, p, _, hi, raw, left in rows_ for x in range(len(raw) - 49) if least[raw[x : x + 50]] < hi}
    assert got == want
    assert sum(compared) == sum(max(0, len(raw) - 49) for _, _, _, _, raw, _ in rows_), "suffixes that start no whole string were compared"


def test_suffix_sorting_packs_symbols(monkeypatch):
    t = np.random.default_rng(3).integers(0, 5, 20000)
    t[7000:7064] = t[:64]
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: sorts.append(len(x)) or argsort(x, *a, **b))
    monkeypatch.setattr(np, "lexsort", lambda keys: pytest.fail("pairs of ranks are one key"))
    sa = succinct.suffix_array(t)
    assert [t[i : i + 99].tolist() for i in sa] == sorted(t[i : i + 99].tolist() for i in range(len(t)))
    assert len(sorts) <= 4 and sum(sorts[1:]) < 2000  # sixteen symbols of three bits are compared at once, so few tie


def test_anchors_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(4)
    data, off = rng.integers(97, 99, 3000).astype(np.uint8), np.unique(np.concatenate([[0, 3000, 64, 65, 128], rng.integers(0, 3000, 25)]))
    sums = suffix_dedup.Sums(data)
    key = sums.hash(np.arange(2981), np.arange(2981) + 20) >> np.uint64(22)
    want = {min(range(i, i + 31), key=lambda p: (key[p], p)) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for i in range(a, b - 49)}
    for size in (1, 31, 64, 1 << 16):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", size)
        pos, h = suffix_dedup.anchors(data, off, sums)
        assert pos.tolist() == sorted(want) and (h == sums.hash(pos, pos + 20)).all()


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0
    t = "the quick brown fox jumps over the lazy dog and then some more words follow"
    got = suffix_dedup.dedup(docs(spark, [t, t, t + "!", t, "own " + t], [2, 2, 2, None, 5]))
    assert rows(got, "doc_id", "n_removed") == sorted([(2, 0), (2, 0), (2, 0), (None, 0), (5, len(t))], key=repr)


# 7
def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = [(int(i), [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(0, 330, 3)]
    vecs += [(400, vecs[0][1]), (50, None), (100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (200, [float("nan")] + [0.0] * 5), (250, [1.0, 2.0]), (None, vecs[1][1])]
    vecs += [(500 + k, vecs[3][1]) for k in range(12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<float>, score int")
    got = rows(bitsliced.top_k(df, block_rows=16, block_queries=2), "query_id", "rank", "vec_id", "score")
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vecs if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q, x in ok.items():
        if q % 50 == 0:
            s = sorted((-int(x @ y), i) for i, y in ok.items() if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i, -d) for k, (d, i) in enumerate(s)]
    assert got == sorted(want, key=repr)
    assert bitsliced.top_k(df.limit(0)).count() == 0


def test_topk_of_large_numbers_and_repeated_ids(spark):
    """Sums beyond 62 bits are exact where they fit; what does not fit is refused, not wrapped."""
    big = float(1 << 32)
    vecs = [(7, [1.0, big]), (1, [-1.0, -big]), (2, [big / 4, 1.0]), (3, [0.0, 2.0]), (3, [0.0, 3.0]), (50, [2.0, 4.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bitsliced.top_k(df, k=3).filter("query_id = 50").collect()}
    q = [256 * 2, 256 * 4]
    best = sorted([(-(q[0] * int(256 * v[0]) + q[1] * int(256 * v[1])), i) for i, v in vecs if i != 50])[:3]
    assert got[50, 1] == (best[0][1], -best[0][0])
    with pytest.raises(Exception, match="int|long|overflow|large"):
        bitsliced.top_k(spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")).collect()
    with pytest.raises(Exception, match="does not fit the index"):
        bitsliced.top_k(spark.createDataFrame([(0, [2.0**60]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_slices_round_trip():
    v = np.random.default_rng(3).integers(-500, 500, (70, 3))
    a = bitsliced.BitSliced(v)
    b = bitsliced.BitSliced.load(a.dump())
    assert (b.low == a.low).all() and b.width == a.width and all((x == y).all() for c, d in zip(a.slices, b.slices, strict=True) for x, y in zip(c, d, strict=True))


# 8
def test_tokens_against_the_library(spark):
    path = token_output.tokenizer_path()
    enc = token_output.Encoder(path)
    rng = random.Random(8)
    parts = list("ab's'tre ve  \n\t.!?12é　") + ["'re", "'ll", " 's", "\n's", "<|endoftext|>", "\U0001f600", " the", "word"]
    texts = [None, "", "x " * 4000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    shards = token_output.write_tokens(docs(spark, texts, ids), path, shard_tokens=500)
    assert shards.count() > 4
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_documents(shards).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        want = [*enc.tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert token_output.read_documents(token_output.write_tokens(docs(spark, []), path)).count() == 0
    # The same file answers for some documents, for counts and for occurrences.
    truth = {i: [*enc.tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(ids, texts, strict=True)}
    some = token_output.tokens_of(shards, [ids[2], ids[0], ids[50], -5])
    assert {r.doc_id: r.ids for r in some.collect()} == {i: truth[i] for i in (ids[2], ids[0], ids[50])}
    ask = [2, truth[ids[2]][0], 49999]
    assert {r.token: r.n for r in token_output.token_counts(shards, ask).collect()} == {a: sum(v.count(a) for v in truth.values()) for a in ask}
    places = {(r.doc_id, r.place) for r in token_output.token_occurrences(shards, ask[1]).collect()}
    assert places == {(i, k) for i, v in truth.items() for k, x in enumerate(v) if x == ask[1]}
    odd = token_output.read_documents(token_output.write_tokens(docs(spark, ["b", "a", None], [None, 1, 1]), path))
    assert sorted(r.start for r in odd.collect()) == [0, 2, 3]


# 9
def test_new_words_go_to_the_model_alone():
    """No text of certain split passes the library's splitter, and all bytes and kinds of white space are spelled as it does."""
    from silvatide.llm import token_output

    enc = token_output.Encoder(token_output.tokenizer_path())
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(1, 128), *range(0xA1, 0x180), 0x3B1, 0x4E2D, 0x2028, 0x1D400) if enc.classes[c] != token_output.UNSURE]
    texts = ["", "it's  a\n\n test 123 --", *letters, *("".join(rng.choice(letters) for _ in range(60)) for _ in range(300))]
    texts += [" ".join(w) for w in zip(texts[3:40], texts[60:97], strict=True)]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    enc.tok = None
    ids, n = enc.encode(texts)
    assert ids.tolist() == list(itertools.chain(*want)) and n.tolist() == [len(w) for w in want]


def test_mixing(spark):
    sources = ["a"] * 40 + ["b"] * 10 + [None] * 30 + ["é"] * 5
    texts = [" ".join(["w"] * (k % 7 + 1)) for k in range(85)]
    texts[3], texts[4] = None, ""
    df = docs(spark, texts, sources=sources)
    got = mixing.mix_sources(df, steps=2).collect()
    size = {s: sum(r.size for r in got if sources[r.doc_id] == s) for s in set(sources)}
    total, left, goal = sum(size.values()), dict(zip(["a", "b", "é", None], [5, 2, 1, 5], strict=True)), {}
    while True:
        unit = (total - sum(goal.values())) / sum(left.values())
        full = [s for s in left if unit * left[s] > 3 * size[s] + 1e-9]
        if not full:
            break
        for s in full:
            goal[s] = 3 * size[s]
            del left[s]
    goal |= {s: unit * w for s, w in left.items()}
    for s in size:
        taken = [r for r in got if sources[r.doc_id] == s]
        assert {r.source_size for r in taken} == {size[s]}
        assert taken[0].target == pytest.approx(goal[s])
        assert abs(sum(r.taken for r in taken) - goal[s]) <= 7
        assert max(r.n_copies for r in taken) - min(r.n_copies for r in taken if r.size) <= 1
    assert all(r.taken <= 3 * r.size for r in got)
    again = mixing.mix_sources(df.repartition(3), steps=2)
    assert rows(again, "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.n_copies for r in got)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    blank = mixing.mix_sources(docs(spark, [None, ""])).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0), (0.0, 0)]


def test_mixing_learns_weights(spark):
    """Long words are good here and short ones bad; weighted sampling then prefers the good."""
    texts = [" ".join(["goodword" if k % 2 else "b"] * 10) for k in range(400)]
    df = docs(spark, texts, sources=["a"] * 200 + ["z"] * 200)
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(7, None)], "doc_id long, quality int")
    got = mixing.mix_sources(df, labels, steps=4).collect()
    taken = [[sum(r.n_copies for r in got if r.doc_id % 2 == y and (r.doc_id < 200) == s) for y in (0, 1)] for s in (True, False)]
    assert sum(r.size for r in got) == 4000 and taken[1][1] > 3 * taken[1][0]
    # Repeated ids are drawn alike, and each row counts.
    twice = docs(spark, texts[:50] * 2, list(range(50)) * 2, ["a"] * 100)
    again = mixing.mix_sources(twice, labels, steps=4).collect()
    assert len(again) == 100 and all(len({r.n_copies for r in again if r.doc_id == k}) <= 2 for k in range(50))
    clash = df.select("doc_id", "text", "source", F.lit(1).alias("_key"), F.lit(2).alias("n_copies"), F.lit(3).alias("_copy"))
    assert mixing.mixed(clash, labels).columns == clash.columns


@pytest.mark.parametrize("w", [1e-6, 0.01, 0.05, 0.3, 1.0])
def test_no_range_of_times_is_hot(w):
    """Whatever the weight, no step of the logarithm holds more than its share of the draws."""
    u = (np.random.default_rng(1).integers(0, 1 << 48, 1_000_000) + 0.5) / (1 << 48)
    n = np.unique(np.floor(np.log(-np.log(u) / w) * mixing.STEPS), return_counts=True)[1]
    assert n.max() / 1e6 < 1 / (math.e * mixing.STEPS) * 1.5


# 10
def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(10)
    trans = rng.normal(0, 1, (2, 2))
    for n in (1, 2, 5):
        s = rng.normal(0, 2, n)
        total, on = 0.0, np.zeros(n)
        for code in range(1 << n):
            tags = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(s[k] * tags[k] for k in range(n)) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total, on = total + w, on + w * np.array(tags)
        assert toxicity.forward_backward([s, rng.normal(0, 1, 3)], trans)[0] == pytest.approx(on / total)


def test_whole_chains_from_their_known_words():
    """Skipping over plain words gives what the whole chain does, at both ends too."""
    rng = np.random.default_rng(12)
    for bias in (-2.0, 0.3, -40.0):
        trans = rng.normal(0, 1.5, (2, 2))
        size = np.array([200, 1, 7, 40, 3])
        held = [np.sort(rng.choice(n, min(n, k), replace=False)) for n, k in zip(size, (5, 1, 7, 9, 1), strict=True)]
        chain = np.repeat(np.arange(5), [len(h) for h in held])
        at, gain = np.concatenate(held), rng.normal(0, 3, len(chain))
        got = toxicity.sparse_marginals(at, chain, size, gain, bias, trans)
        full = [np.full(n, bias) for n in size]
        for c, a, g in zip(chain, at, gain, strict=True):
            full[c][a] += g
        want = toxicity.forward_backward(full, trans)
        assert got == pytest.approx([want[c][a] for c, a in zip(chain, at, strict=True)], rel=1e-9, abs=1e-12)


def test_toxicity_edges(spark):
    assert toxicity.train([]).keys.size == 0 and toxicity.train([("a b", 1)]).keys.size == 0
    texts = ["quiet words here"] * 6 + ["zzzbad words here"] * 6
    labels = spark.createDataFrame([(k, int(k >= 6)) for k in range(12)], "doc_id long, toxic int")
    df = docs(spark, [f"{t} {k}" for k, t in enumerate(texts)])
    model = toxicity.fit(df, labels)
    blank = toxicity.score_documents(docs(spark, [None, "", "zzzbad x", "zzzbad x"], [1, 1, 2, 2]), model).collect()
    assert [round(r.score, 6) for r in blank[:2]] == [0.0, 0.0] and blank[2].score == blank[3].score and toxicity.score_documents(df.limit(0), model).count() == 0
    # The score is the noisy-or of the marginals of the words it knows.
    w = toxicity._words_of("zzzbad x y zzzbad")
    p = model.marginals(w)[1]
    one = toxicity.score_documents(docs(spark, ["zzzbad x y zzzbad"]), model).first()
    assert one.score == pytest.approx(1 - np.prod(1 - p)) and [(s.start, s.end) for s in one.spans] == [(0, 6), (11, 17)]
    clash = df.withColumnRenamed("h", "spans")
    assert toxicity.drop_toxic(clash, labels).columns == clash.columns


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(10)
    plain = [f"w{k}" for k in range(200)]
    bad = ["vile", "scumbag"] + [f"nasty{k}" for k in range(30)]
    texts, labels = [], []
    for k in range(600):
        t = [rng.choice(plain) for _ in range(rng.randint(3, 40))]
        y = k % 4 == 0
        if y:
            t[rng.randrange(len(t))] = rng.choice(bad)
        texts.append(" ".join(t))
        labels.append((k, 1, int(y)))
    texts += [None, "", "nastyunseen", "w1 " * 9000]
    df = docs(spark, texts)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    held = [k for k in range(600) if toxicity.held_out(k)]
    assert len(held) > 80
    assert sum((got[k].score >= 0.5) == (k % 4 == 0) for k in held) / len(held) > 0.97
    assert [got[k].score for k in (600, 601, 603)] == [0.0, 0.0, 0.0] and got[602].score >= 0.5
    assert got[602].spans == [(0, 11)]
    empty = toxicity.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(df, empty).filter("score > 0").count() == 0
    assert toxicity.score_documents(docs(spark, []), model).count() == 0
    assert toxicity.drop_toxic(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    assert spark.createDataFrame([(k,) for k in range(50)], "i long").select((toxicity.fold(F.col("i")) == 0).alias("h")).collect() == [(toxicity.held_out(k),) for k in range(50)]


def test_toxicity_learns_from_whole_documents():
    rng = random.Random(11)
    plain = lambda n: [f"w{rng.randrange(200)}" for _ in range(n)]
    bad = [f"q{j:02}zz" for j in range(60)]
    long = [" ".join([*[x for b in rng.sample(bad, 9) for x in [*plain(20), b]], *plain(20), "telling"]) for _ in range(80)]
    short = [" ".join([*plain(5), b, *plain(5)]) for b in bad for _ in range(5)]
    model = toxicity.train([(t, 1) for t in long + short] + [(" ".join(plain(30)), 0) for _ in range(300)])
    # It stands only after nine other tagged words of each document.
    assert textops.hash_words([b"telling"])[0] in model.keys
    w = textops.Words(*textops.text_buffer(pa.array([" ".join([*plain(9), "telling", *plain(9)])])))
    assert model.marginals(w)[1].max() > 0.5
