"""HTML extraction: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks with the number of words and the link
density of each block and of its neighbours, and what the markup around it says:
whether it lies in a container that is never main text, in one whose class merely
sounds like that, in a main container, in a paragraph, in a heading. A CART tree,
grown here from a small labelled table, keeps or drops each block; where markup is
doubtful or absent, words, links and neighbours decide. What stands in a main
container under no doubtful word stays, links and short lines too; outside of it
nothing does.

A page is read once from its start to its end, whatever it holds: tags that are
never closed or cut off cost no more than others.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import arrow_map, only, table
from .textops import column

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg object select".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button head title".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre td th dd dt li figcaption caption".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Class words of what is no main text, where a class says nothing else: `share`, `related-posts`, but not `share-price`.
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promoted promotion sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login related recommended share sharing comment comments commentlist reply replies respond disqus widget pagination pager".split()
)
#: Class words that say what an element is made of or where it stands, and not what it is about.
FRAME_WORDS = frozenset(
    "x box bar list container wrapper wrap inner outer block panel section area region zone row col column grid slot unit group item items link links button buttons icon icons tool tools form field title "
    "head header heading body content text left right top bottom center primary secondary main site page post posts article articles entry story stories blog news js c is has the and of size small large "
    "mobile desktop sticky fixed thread author meta count form user users social menu policy notice message widgets".split()
)
#: Class words that prose may have as well.
DOUBTFUL_WORDS = frozenset("menu header notice alert subscription register form side social discussion copyright legal skip toolbar".split())
ASIDE_WORDS = frozenset("ad advert advertisement comment comments promo related reply sponsored".split())  # on an article element itself
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog".split())
MAIN_WORDS = frozenset("article content post entry story main body text maincontent articlebody".split())
#: How notices begin.
NOTICE = re.compile(r"(?:©|\(c\)\s|copyright\b|all rights reserved|advertisement\b|this (?:web)?site uses cookies|we use cookies)", re.I)

# A tag runs to the next > that no quoted value holds; a quote counts after an equals sign only. Nothing is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*+>?+", re.S)
_ATTR = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(\"[^\"]*+\"?+|'[^']*+'?+|[^\s\"']++))?+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?+", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    boiler: int  # inside a container of boilerplate
    doubtful: int  # inside a container whose class sounds like it
    notice: int  # worded like a notice
    main: int  # inside a main container
    paragraph: int
    heading: int


def _hint(name: str, attrs: str, in_main: bool) -> str:
    """'boiler', 'doubtful', 'main', 'top' (an article's own header, of which only headings count) or '' for an element."""
    if name == "header" and in_main:
        return "top"
    if name in BOILER_TAGS:
        return "boiler"
    found = "main" if name in MAIN_TAGS else ""
    if not attrs or attrs.isspace():
        return found
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return "boiler"
        if key == "role":
            if value in BOILER_ROLES:
                return "boiler"
            found = "main" if value in ("main", "article") else found
        elif key in ("class", "id") and name not in ("body", "html"):
            classes = [{w for w in re.split(r"[^a-z]+", c) if w} for c in value.split()]
            parts = set().union(*classes)
            if name in MAIN_TAGS:
                if parts & ASIDE_WORDS:
                    return "boiler"
            elif any(c & BOILER_WORDS and c <= BOILER_WORDS | FRAME_WORDS for c in classes):
                if name not in PARAGRAPHS and name not in HEADINGS:
                    return "boiler"
                found = found or "doubtful"
            elif parts & (BOILER_WORDS | DOUBTFUL_WORDS):
                found = found or "doubtful"
            elif parts & MAIN_WORDS:
                found = "main"
    return found


class _Open:
    """The open elements. The places of each name, of blocks and of what ends where are at hand, so that nothing is searched for."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.depth = dict.fromkeys(("boiler", "doubtful", "main", "top", "a", "h", "p"), 0)

    def _count(self, name: str, hint: str, by: int) -> None:
        if hint:
            self.depth[hint] += by
        if name == "a":
            self.depth["a"] += by
        elif name in HEADINGS:
            self.depth["h"] += by
        elif name in PARAGRAPHS:
            self.depth["p"] += by

    def push(self, name: str, hint: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, hint))
        self._count(name, hint, 1)

    def close(self, to: int) -> None:
        while len(self.stack) > to:
            name, hint = self.stack.pop()
            if name:
                self.places[name].pop()
                if name not in INLINE:
                    self.blocks.pop()
                self._count(name, hint, -1)

    def last(self, *names: str) -> int:
        """The innermost of these elements, or -1."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def end(self, name: str) -> None:
        """An end tag. One of an inline element closes nothing outside its block."""
        k = self.last(name)
        if k >= 0 and not (name in INLINE and self.blocks and k < self.blocks[-1]):
            self.close(k)

    def no_link(self) -> None:
        """A link ends the link that is open; what it holds stays open."""
        k = self.last("a")
        if k >= 0:
            self._count(*self.stack[k], -1)
            self.stack[k] = ("", "")
            self.places["a"].pop()


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page. A block ends at any block-level tag; a line break or inline tag only separates or joins words."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    opened = _Open()
    depth = opened.depth

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                n = text.count(" ") + 1
                in_link = len(entities.unescape("".join(linked)).split())
                boiler = depth["boiler"] > 0 or depth["top"] > 0 and not depth["h"]
                notice = NOTICE.match(text) is not None
                out.append(Block(text, n, min(1.0, in_link / n), int(boiler), int(depth["doubtful"] > 0), int(notice), int(depth["main"] > 0), int(depth["p"] > 0), int(depth["h"] > 0)))
            parts.clear()
            linked.clear()

    def text(raw: str) -> None:
        parts.append(raw)
        linked.append(raw if depth["a"] else " ")  # words of two links are two words

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            m = _OTHER.match(page, lt)
            if m is None:
                text("<")
                at = lt + 1
                continue
            at = m.end()
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        at = m.end()
        if not m[4]:  # a tag that the end of the page cuts off
            break
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            if name not in INLINE:
                flush()
            opened.end(name)
            continue
        closed = attrs.rstrip().endswith("/")
        if name in RAW:
            if not closed:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
            continue
        if name in INLINE:
            if name == "a":
                opened.no_link()
        elif name == "br":
            text(" ")
            continue
        elif name == "img":
            continue
        else:
            flush()
            _implied_end(name, opened)
        if name not in VOID and not (closed and name not in INLINE and "=" not in attrs):
            opened.push(name, _hint(name, attrs, depth["main"] > 0))
    flush()
    return out


_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def _implied_end(name: str, opened: _Open) -> None:
    """A block-level tag ends an open paragraph with what inline elements it left open; an item ends the item before it."""
    if opened.blocks and opened.stack[opened.blocks[-1]][0] == "p":
        opened.close(opened.blocks[-1])
    if name in _ITEMS:
        same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
        k = opened.last(*same)
        if k > opened.last(*_ITEMS[name]):
            opened.close(k)


FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "boiler", "doubtful", "notice", "place", "paragraph", "heading")

# Pages whose blocks are labelled by hand: whether a block belongs to the main text, and its markup; {n} stands for n words. The pages
# are made after news, blogs, documentation, shops and wikis; the features of their blocks are computed as those of any page.
LABELLED = (
    (  # news: everything has its container
        (0, "<header><a href=/>{1}</a></header>"), (0, "<nav><ul><li><a href=/a>{1}</a></li>"), (0, "<li><a href=/b>{1}</a></li>"), (0, "<li><a href=/c>{2}</a></li></ul></nav>"), (0, "<div class='ad'>{7}</div>"),
        (1, "<article><h1>{9}</h1>"), (1, "<p>{60}</p>"), (1, "<p>{1}</p>"), (1, "<p>{34} <a href=x>{2}</a> {10}</p>"), (0, "<div class=ad>{12}</div>"), (1, "<h2>{4}</h2>"), (1, "<p>{8}</p>"), (1, "<p>{90}</p></article>"),
        (0, "<section id=comments><h3>{2}</h3>"), (0, "<p>{70}</p>"), (0, "<p>{15}</p></section>"), (0, "<aside><a href=z>{6}</a></aside>"), (0, "<footer>{12}</footer>"),
    ),
    (  # news: link blocks and long teasers lie round the article, in no container that says so
        (0, "<div>{55}</div>"), (0, "<div><a href=1>{3}</a></div>"), (0, "<div>{42}</div>"), (0, "<div><a href=2>{5}</a></div>"), (0, "<p>{30}</p>"), (1, "<article><p>{25}</p>"), (1, "<p>{70}</p>"), (1, "<p><a href=3>{6}</a></p>"),
        (1, "<p>{64}</p>"), (1, "<p><a href=4>{2}</a></p></article>"), (0, "<p>{80}</p>"), (0, "<div><a href=5>{4}</a></div>"), (0, "<h3>{5}</h3>"), (0, "<p>{38} <a href=6>{2}</a></p>"), (0, "<div>{3}</div>"),
    ),
    (  # a column of links and figures inside an article
        (1, "<main><h1>{6}</h1>"), (1, "<p><a href=1>{11}</a></p>"), (1, "<p><a href=2>{26}</a></p>"), (1, "<ul><li><a href=3>{2}</a></li>"), (1, "<li><a href=4>{1}</a></li>"), (1, "<li><a href=5>{3}</a> {9}</li></ul>"),
        (1, "<div>{2}</div>"), (1, "<table><tr><td>{1}</td>"), (1, "<td><a href=6>{4}</a></td></tr></table>"), (1, "<div><a href=7>{5}</a></div>"), (1, "<p>{120}</p>"), (1, "<div><a href=8>{18}</a></div>"), (1, "<div>{5}</div>"),
        (1, "<div><a href=9>{2}</a></div>"), (1, "<div>{6}</div>"), (1, "<div><a href=9>{3}</a></div>"), (1, "<h2>{3}</h2>"), (1, "<ul><li><a href=9>{4}</a></li></ul>"), (1, "<div>{4}</div>"), (1, "<div><a href=9>{7}</a></div></main>"), (0, "<p>{10}</p>"),
    ),
    (  # prose of an article under class words that only sound like boilerplate
        (1, "<article><p class=legal>{3}</p>"), (1, "<p class=notice>{12}</p>"), (1, "<p>{50}</p>"), (1, "<p class=legal>{4}</p>"), (1, "<p>{7}</p>"), (1, "<div class=share-price>{5}</div>"), (1, "<div class='social history'><p>{60}</p>"),
        (1, "<p>{6}</p></div>"), (1, "<section class=related-work><h2>{2}</h2>"), (1, "<p>{44} <a href=1>{3}</a></p>"), (1, "<p>{9}</p></section>"), (1, "<p class=comment>{33}</p>"), (1, "<p class=alert>{5}</p>"), (1, "<p>{65}</p></article>"),
        (0, "<p class=legal>{11}</p>"), (0, "<p class=copyright>{50}</p>"),
    ),
    (  # prose straight in divisions of doubtful class
        (1, "<article><div class='social history'>{35}</div>"), (1, "<div class=legal>{55}</div>"), (1, "<h2>{3}</h2>"), (1, "<div class=discussion>{90} <a href=1>{2}</a></div>"), (1, "<p>{4}</p>"), (1, "<div class='side effects'>{40}</div>"), (1, "<p>{66}</p>"), (1, "<div class=share-price>{5}</div>"), (1, "<p>{4}</p>"),
        (1, "<p>{75}</p>"), (1, "<div class=ad-hoc>{9}</div>"), (1, "<p>{48}</p>"), (1, "<div class=legal>{3}</div>"), (1, "<p>{2}</p></article>"), (0, "<div class=legal>{40}</div>"),
    ),
    (  # share bars, menus and notices inside an article, under the same words
        (1, "<article><h1>{7}</h1>"), (0, "<div class=social><a href=1>{1}</a></div>"), (0, "<div class=social><a href=2>{2}</a></div>"), (1, "<p>{45}</p>"), (0, "<ul class=toolbar><li><a href=3>{1}</a></li>"), (0, "<li><a href=4>{2}</a></li></ul>"),
        (1, "<p>{52}</p>"), (0, "<p class=subscription>{2} <a href=5>{9}</a></p>"), (1, "<p>{40}</p>"), (0, "<p class=share><a href=6>{6}</a></p>"), (1, "<p>We use cookies {5}</p>"), (1, "<p>{30}</p>"), (0, "<div>Advertisement</div>"), (1, "<p>{11}</p>"),
        (1, "<p>Advertisement {3}</p>"), (1, "<p>All rights reserved</p>"), (0, "<div>Copyright {6}</div>"), (0, "<div>We use cookies {9}</div>"), (1, "<p>© {4}</p>"), (0, "<div class=social><a href=7>{3}</a> {2}</div></article>"), (0, "<div class=legal>{6}</div>"),
    ),
    (  # paragraphs of an article worded like notices, and notices in divisions of it
        (1, "<article><p>All rights reserved {1}</p>"), (1, "<p>{2}</p>"), (1, "<p>Copyright {8}</p>"), (0, "<div>We use cookies {4}</div>"), (1, "<p>{12}</p>"), (0, "<div>We use cookies {7}</div>"), (1, "<p>We use cookies {3}</p>"), (1, "<p>{9}</p>"),
        (0, "<div>Advertisement {1}</div>"), (1, "<p>{25}</p>"), (0, "<div>© {5}</div>"), (1, "<p>All rights reserved</p>"), (1, "<p>{80}</p>"), (1, "<p>All rights reserved</p>"), (0, "<div>All rights reserved {2}</div>"), (1, "<p>Copyright {10}</p></article>"),
    ),
    ((1, "<article><p>{20}</p>"), (1, "<p>All rights reserved</p></article>"), (0, "<footer>© {4}</footer>")), ((0, "<nav><a href=1>{1}</a></nav>"), (1, "<article><p>All rights reserved</p></article>")),
    ((1, "<article><p>{50}</p>"), (0, "<div>All rights reserved</div></article>"), (0, "<p>{6}</p>")), ((1, "<article><p>{15}</p>"), (0, "<div>This website uses cookies {4}</div>"), (1, "<p>{30}</p></article>")),
    (  # an article that begins as notices do, and says much more
        (1, "<article><p>Copyright {60}</p>"), (1, "<p>{8}</p>"), (1, "<p>Advertisement {45}</p>"), (1, "<p>We use cookies {38} <a href=1>{3}</a></p></article>"), (0, "<footer><p>Copyright {50}</p></footer>"), (0, "<p>All rights reserved</p>"),
    ),
    (  # a share bar, adverts, forms and reader comments in their containers inside an article
        (1, "<article><p>{30}</p>"), (0, "<div class=share-buttons><a href=1>{1}</a></div>"), (0, "<aside>{35}</aside>"), (0, "<form>{6}</form>"), (1, "<p>{28}</p>"), (0, "<div class='related-posts'><p>{90}</p></div>"), (1, "<p>{3}</p>"),
        (0, "<div class=share><a href=1>{1}</a></div>"), (0, "<nav><a href=1>{2}</a></nav>"), (0, "<div class=ad><a href=1>{14}</a></div>"), (0, "<div class=promo><p><a href=1>{30}</a> {5}</p></div>"), (0, "<aside><h3><a href=1>{6}</a></h3></aside>"),
        (0, "<div class=comment-list><p>{120} <a href=2>{1}</a></p>"), (0, "<p>{4}</p></div></article>"), (0, "<div class=sidebar><p>{70}</p></div>"),
    ),
    (  # no container: a blog between two menus
        (0, "<ul><li><a href=1>{1}</a></li>"), (0, "<li><a href=2>{2}</a></li></ul>"), (1, "<h1>{6}</h1>"), (1, "<p>{70}</p>"), (1, "<p>{8}</p>"), (1, "<p>{40} <a href=3>{3}</a></p>"), (1, "<h2>{3}</h2>"), (1, "<p>{22}</p>"), (1, "<p>{3}</p>"), (1, "<p>{55}</p>"),
        (0, "<p><a href=4>{4}</a></p>"), (0, "<p><a href=5>{3}</a></p>"), (0, "<div>Copyright {3}</div>"),
    ),
    (  # no container, no paragraphs: text in divisions
        (0, "<div><a href=1>{2}</a></div>"), (0, "<div><a href=2>{3}</a></div>"), (1, "<div>{90}</div>"), (1, "<div>{25} <a href=3>{2}</a></div>"), (1, "<div>{3}</div>"), (1, "<div>{40}</div>"), (0, "<div><a href=4>{15}</a> {3}</div>"),
        (0, "<div><a href=5>{3}</a></div>"), (0, "<div>{4}</div>"), (0, "<div><a href=6>{1}</a></div>"), (0, "<div>{6}</div>"), (0, "<div><a href=7>{3}</a></div>"), (1, "<div>{60}</div>"), (0, "<div><a href=8>{2}</a></div>"),
    ),
    (  # no main container, but menus, adverts, comments and a footer in theirs
        (0, "<nav><a href=1>{1}</a></nav>"), (0, "<div class=banner>{30}</div>"), (1, "<h1>{7}</h1>"), (1, "<p>{60}</p>"), (0, "<div class=ad>{12}</div>"), (1, "<p>{40}</p>"), (1, "<p>{5}</p>"), (0, "<aside><p>{70}</p></aside>"),
        (0, "<div class=comments><p>{90}</p>"), (0, "<p>{3}</p></div>"), (0, "<form>{8}</form>"), (0, "<footer>{35}</footer>"),
    ),
    # no container: very short texts
    ((1, "<p>{1}</p>"),), ((1, "<div>{20}</div>"),), ((1, "<div>{30}</div>"), (1, "<div>{4}</div>")), ((1, "<p>{3}</p>"), (1, "<p>{1}</p>"), (1, "<p>{1}</p>"), (1, "<p>{7}</p>")), ((1, "<h1>{5}</h1>"), (1, "<p>{4}</p>")),
    ((1, "<div>{45}</div>"), (1, "<div>{6}</div>"), (1, "<div>{45}</div>")), ((1, "<p>{14}</p>"), (1, "<p>{9}</p>")), ((1, "<h2>{5}</h2>"), (1, "<p>{80}</p>")), ((1, "<div>{2}</div>"), (1, "<div>{12}</div>")),
    (  # no container: links between paragraphs, and a link of many words
        (1, "<p>{42}</p>"), (0, "<p><a href=1>{9}</a></p>"), (1, "<p>{42}</p>"), (0, "<p><a href=2>{50}</a> {5}</p>"), (0, "<p><a href=3>{3}</a></p>"), (0, "<div><a href=4>{20}</a> {4}</div>"), (0, "<div><a href=5>{16}</a> {6}</div>"), (0, "<div>{3} <a href=6>{6}</a></div>"),
    ),
    (  # no container: a few words among links
        (0, "<p><a href=1>{1}</a></p>"), (0, "<div>{6}</div>"), (0, "<div><a href=2>{2}</a></div>"), (0, "<div>{3}</div>"), (0, "<p><a href=3>{3}</a></p>"), (0, "<div>{5} <a href=4>{4}</a></div>"), (0, "<p><a href=5>{1}</a></p>"), (0, "<p>{2}</p>"), (0, "<p><a href=6>{1}</a></p>"),
        (0, "<div>{7}</div>"), (0, "<div><a href=7>{2}</a></div>"), (0, "<div>{5}</div>"), (0, "<div><a href=8>{4}</a></div>"), (0, "<div>{8}</div>"), (0, "<p><a href=9>{6}</a></p>"), (0, "<p>{4}</p>"), (0, "<p><a href=9>{2}</a></p>"), (0, "<p>{6}</p>"), (0, "<ul><li><a href=9>{2}</a></li></ul>"),
    ),
    ((0, "<div><a href=1>{2}</a></div>"), (0, "<div>{6}</div>"), (0, "<div><a href=2>{2}</a></div>")), ((0, "<p><a href=1>{1}</a></p>"), (0, "<p>{7}</p>"), (0, "<p><a href=2>{3}</a></p>")),
    (  # no container: prose and its opposite under doubtful class words
        (0, "<div class=menu><a href=1>{1}</a></div>"), (1, "<div class='social history'><p>{50}</p>"), (1, "<p>{26}</p>"), (1, "<p>{45} <a href=2>{1}</a></p></div>"), (0, "<div class=legal>{5}</div>"), (0, "<div class=copyright>{8}</div>"), (0, "<div class=social><a href=3>{2}</a> {9}</div>"),
    ),
    ((1, "<div class='social history'><p>{40}</p></div>"),), ((1, "<p>{60}</p>"), (0, "<div class=legal>{5}</div>")), ((1, "<p>{25}</p>"), (0, "<p>© {4}</p>")), ((1, "<p>{70}</p>"), (0, "<p>We use cookies {8}</p>"), (0, "<a href=1>{3}</a>")),
    # no container: one long text between links
    ((0, "<p><a href=1>{1}</a></p>"), (1, "<p>{42}</p>"), (0, "<p><a href=2>{2}</a></p>")), ((0, "<div><a href=1>{2}</a></div>"), (1, "<div>{70} <a href=2>{2}</a></div>")), ((0, "<p><a href=1>{3}</a></p>"), (1, "<p>{55}</p>"), (1, "<p>{6}</p>")),
)


def labelled() -> list[tuple[tuple[float, ...], int]]:
    """The features and the label of each block of the labelled pages."""
    out = []
    for parts in LABELLED:
        page = re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), "".join(markup for _, markup in parts))
        out += zip(features(blocks(page)), [keep for keep, _ in parts], strict=True)
    return out


#: Features that are plain facts of the page, and no measures.
FACTS = tuple(FEATURES.index(f) for f in ("boiler", "place", "doubtful", "notice"))


class Tree:
    """CART: axis-parallel splits of least Gini impurity, until leaves are pure or would hold less than `least` rows. Facts are split on
    before measures as long as that lowers the impurity, so that few labels do not let a number of words overrule plain markup."""

    def __init__(self, rows: list[tuple[tuple[float, ...], int]] | None = None, least: int = 2):
        rows = labelled() if rows is None else rows
        self.root = self._grow([(list(map(float, x)), y) for x, y in rows], least)

    @staticmethod
    def _gini(ys: list[int]) -> float:
        p = sum(ys) / len(ys)
        return 2 * p * (1 - p) * len(ys)

    def _grow(self, rows, least):
        ys = [y for _, y in rows]
        if len(set(ys)) <= 1 or len(rows) < 2 * least:
            return int(2 * sum(ys) >= len(ys)) if ys else 0
        order = range(len(rows[0][0]))
        best = self._best(rows, [f for f in order if f in FACTS], least) or self._best(rows, order, least)
        if best is None:
            return int(2 * sum(ys) >= len(ys))
        f, cut = best
        return f, cut, self._grow([r for r in rows if r[0][f] <= cut], least), self._grow([r for r in rows if r[0][f] > cut], least)

    def _best(self, rows, fs, least):
        """The feature and the cut of least impurity among these features, or None if none lowers it."""
        best = None
        for f in fs:
            values = sorted({x[f] for x, _ in rows})
            for a, b in zip(values, values[1:], strict=False):
                cut = (a + b) / 2
                left, right = [y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]
                if min(len(left), len(right)) >= least:
                    cost = self._gini(left) + self._gini(right)
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, f, cut)
        return best[1:] if best is not None and best[0] < self._gini([y for _, y in rows]) - 1e-12 else None

    def predict(self, x) -> int:
        node = self.root
        while isinstance(node, tuple):
            f, cut, low, high = node
            node = low if x[f] <= cut else high
        return node


def features(bs: list[Block]) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block; the neighbours of the ends are empty blocks. The place is 1 inside a main container, -1 outside
    on a page that has one, 0 on a page without any."""
    page_main = int(any(b.main and not b.boiler for b in bs))
    ends = [(0, 0.0)]
    sizes = [*ends, *((b.words, b.link_density) for b in bs), *ends]
    return [(b.words, b.link_density, *sizes[k], *sizes[k + 2], b.boiler, b.doubtful, b.notice, 1 if b.main else -page_main, b.paragraph, b.heading) for k, b in enumerate(bs)]


def main_text(page: str | None, tree: Tree) -> str:
    """The kept blocks of a page in order, joined by line ends; empty for null, empty and block-free pages."""
    if not page:
        return ""
    bs = blocks(page)
    return "\n".join(b.text for b, x in zip(bs, features(bs), strict=True) if tree.predict(x))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The id, the columns in `keep`, text and n_chars (code points) for every page.

    Null and empty pages have an empty text; pages of any length are read whole; repeated rows are each extracted; an empty
    table gives no rows; other columns are ignored.
    """
    tree = Tree()
    carried = [id_col, *keep]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carried) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [main_text(x, tree) for x in column(b, html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(column(b, c) for c in carried), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*carried, "text", "n_chars"])

    return arrow_map(only(pages, *carried, html_col), run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages; what extract_text says of nulls, long and repeated pages and empty tables holds."""
    return extract_text(table(spark, sf_dir, "pages"))


#: For pages as these tables hold them: one article of headings and paragraphs, whose blocks begin and end at their tags.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
c AS (SELECT page_id, url, regexp_replace(body, '(?s)<!--.*?-->|<(script|style)>.*?</(script|style)>|<div class="ad">.*?</div>', '', 'g') AS body FROM a),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(h1|p|div|li|ul)>', chr(1), 'g'), '<br>', ' ', 'g'), chr(1)) AS parts FROM c),
t AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;?', chr(39), 'g'), '&copy;?', chr(169), 'g'), '&middot;?', chr(183), 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(parts, chr(10)), '')) AS BIGINT) AS n_chars FROM t
"""
