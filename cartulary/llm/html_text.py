"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of text at block tags.  A block is described by its own word count and link density and those
of two neighbours on either side, by what kind of element holds it, by where it stands to the page's article element if there is one,
and by how far names of its markup speak of furniture.  A tree grown on the labelled pages below weighs all of these; no name
and no element decides by itself.  A name counts only where it is an element's own: one that holds the page's article, or
most words of the page or article it is in, is a wrapper, and what it is called says nothing of its text.

Defined results: a null or empty page gives the empty text; comments, scripts and styles that are never closed end with the
page, other elements that are never closed end as HTML's optional end tags let them, at the latest with the next block; the
labels of buttons and choices are no text; repeated rows give equal texts; extra columns pass through, ``text`` replaces a
column of that name; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartulary.llm.byte_bpe import _schema, _with
from cartulary.llm.common import per_slice

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?][^>]*>", re.S)
#: Elements whose content is no text of the page: of the first two even if they are never closed.
RAW = frozenset("script style".split())
SILENT = RAW | frozenset("noscript template svg math title iframe object canvas textarea".split())
#: Labels of form controls: silent up to their end tag or the next block.
CONTROLS = frozenset("select option optgroup button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLES = frozenset(("article", "main"))
CONTAINERS = FURNITURE | ARTICLES | frozenset("div section ul ol dl table header center".split())
#: Elements that may be wrappers of most of a page whatever they are called.
WRAPPERS = frozenset("div section table center form fieldset article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
#: Names in a class, id or role that speak of page furniture, and words that go with them: share-bar does, related-work only in part.
MARKS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets contentinfo complementary search".split()
)
HELPERS = frozenset("area bar block bottom box btn buttons column container content form global inner item items left links list main outer page panel post posts primary right secondary section site sub thread top unit wrap wrapper 1 2 3".split())
NAMES = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)

#: How far a name speaks of furniture.
WHOLLY, PARTLY = 1.0, 0.5
#: A wrapper on a page without an article holds at least so many words that are no links, and more than half of all.
WRAPPED = 50
#: text, words, linked words, mark, kind of element, blocks from the article (0: in it), whether the page has one
Block = tuple[str, int, int, float, int, int, int]


def named(values: str) -> float:
    """What the names in a class, id or role say."""
    best = 0.0
    for value in values.lower().split():
        parts = NAMES.findall(value)
        if not MARKS.isdisjoint(parts):
            best = max(best, WHOLLY if all(p in MARKS or p in HELPERS for p in parts) else PARTLY)
    return best


class _Element:
    """An open or closed element: its own mark, what is around it, and which blocks lie in it."""

    __slots__ = ("around", "article", "end", "hidden", "mark", "name", "start")

    def __init__(self, name: str, around: _Element | None, mark: float, hidden: bool, start: int):
        self.name, self.around, self.mark, self.hidden, self.start, self.end = name, around, mark, hidden, start, -1
        self.article = self if name in ARTICLES else around.article if around else None


def _elements(page: str) -> tuple[list[tuple[str, int, int, _Element | None]], list[_Element]]:
    """(text, words, linked words, innermost element) of each block, and all elements, in page order."""
    out: list[tuple[str, int, int, _Element | None]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[_Element] = []
    every: list[_Element] = []
    in_link, muted, at, size = 0, False, 0, len(page)
    inner, never_closed = None, set()

    def close() -> None:
        if text:
            words = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if words:
                out.append((words, words.count(" ") + 1, len(html.unescape("".join(linked)).split()), inner))
            text.clear()
            linked.clear()

    def pop(k: int) -> None:
        for e in stack[k:]:
            e.end = len(out)
        del stack[k:]

    def put(piece: str) -> None:
        if piece and not muted:
            text.append(piece)
            if in_link:
                linked.append(piece)

    while at < size:
        m = TAG.search(page, at)
        put(page[at : m.start() if m else size])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in SILENT:
            if not m[1] and not m[3].endswith("/"):
                end = None if name in never_closed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = size
                else:
                    never_closed.add(name)
                    muted = name in ("title", "textarea", "iframe")
            continue
        if name in CONTROLS:
            muted = not m[1] or (muted and name in ("option", "optgroup"))
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
                linked += [" "]
            elif name == "br":
                put(" ")
            continue
        close()
        in_link, muted = 0, False
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    pop(k)
                    break
        elif name not in VOID:
            if name in ("p", "li", "td", "th", "tr", "dt", "dd") or name in HEADINGS:
                while stack and (stack[-1].name in ("p", name) or stack[-1].name in HEADINGS):
                    pop(len(stack) - 1)
            around = stack[-1] if stack else None
            mark = WHOLLY if name in FURNITURE or (name == "header" and not (around and around.article)) else 0.0
            if m[3] and name in CONTAINERS:
                mark = max(mark, named(" ".join([next(v for v in a if v is not None) for a in (x.groups() for x in ATTRIBUTE.finditer(m[3]))])))
            stack.append(_Element(name, around, mark, bool(m[3] and HIDDEN.search(m[3])), len(out)))
            every.append(stack[-1])
        inner = stack[-1] if stack else None
    close()
    pop(0)
    return out, every


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; references are decoded and white space inside a block is one space."""
    found, every = _elements(page)
    upto, plain = [0], [0]
    for _, words, links, _ in found:
        upto.append(upto[-1] + words)
        plain.append(plain[-1] + max(0, words - links))
    words_in = lambda e: upto[e.end] - upto[e.start]
    # the page's article: of those that bear no mark the one with most words
    article = max((e for e in every if e.name in ARTICLES and e.mark < WHOLLY), key=words_in, default=None)
    holders, e = set(), article
    while e is not None:
        holders.add(id(e))
        e = e.around
    marks: dict[int, float] = {}
    for e in every:
        own, home = e.mark, e.around.article if e.around else None
        if own and not e.hidden:
            if id(e) in holders:
                own = 0.0
            elif e.name in WRAPPERS:
                whole = words_in(home) if home else upto[-1] if article is None else 0
                if 2 * words_in(e) > whole > 0 and (home or plain[e.end] - plain[e.start] >= WRAPPED):
                    own = 0.0
        marks[id(e)] = max(WHOLLY if e.hidden else own, marks[id(e.around)] if e.around else 0.0)
    inside = [i for i, b in enumerate(found) if b[3] is not None and b[3].article is not None] if article else []
    out = []
    for i, (text, words, links, e) in enumerate(found):
        kind = 0 if e is None else 1 if e.name in HEADINGS else 2 if e.name in PARAGRAPHS else 0
        gap = 0
        if inside:
            k = bisect_left(inside, i)
            before, after = i - inside[k - 1] if k else 99, inside[k] - i if k < len(inside) else 99
            gap = max(-9, -after) if after <= before else min(9, before)
        out.append((text, words, links, marks[id(e)] if e is not None else 0.0, kind, gap, int(article is not None)))
    return out


FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "before2_words", "before2_links", "after2_words", "after2_links", "mark", "kind", "gap", "article", "before_kind", "after_kind", "from_start", "from_end")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: its words and link density, those of two neighbours on either side (none: no words), its mark, its and their kinds, and its place."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([(w, min(1.0, k / w), *rest) for _, w, k, *rest in found], dtype=np.float64)
    edge = np.zeros((2, 3))
    near = np.concatenate([edge, own[:, [0, 1, 3]], edge])
    # where a page has an article, the distance to it tells more than the distance to the page's ends
    place = np.full(len(own), 9) if own[0, 5] else np.minimum(np.arange(len(own)), 9)
    return np.column_stack([own[:, :2], near[1:-3, :2], near[3:-1, :2], near[:-4, :2], near[4:, :2], own[:, 2:], near[1:-3, 2], near[3:-1, 2], place, place[::-1]])


#: Labelled pages: blocks that begin with + are main text; the marks + and - are taken off before training.
LABELLED = (
    '<nav><ul><li><a href="/">-Home</a></li><li><a href="/b">-News</a></li><li><a href="/c">-About us</a></li></ul></nav><div class="ad">-Buy now and save a lot of money today on everything in the shop.</div><article><h1>+How the river came back</h1><p>+The river had been dry for years before the rain came back to the hills.<p>+Yes.</p><p>+People who live along it say that the <a href="/w">water</a> is clear again.</p></article><footer>-&copy; 2020 the site. All rights reserved by the people who own it.</footer>',
    '<header><h1>-The Daily Page</h1><a href="/">-Home</a></header><main><h2>+A short note</h2><p>+It works.</p><p>+Nobody knows why, but every test has passed since the change was made last week.</p><ul><li>+first point</li><li>+second point, somewhat longer than the first one</li></ul></main><aside><p>-Read also: ten things that you never knew about the sea and the birds that live there.</p></aside><footer><a href="/t">-Terms</a> -and more</footer>',
    '<div id="header">-Site name</div><div id="menu"><a href="a">-One</a> <a href="b">-Two</a> <a href="c">-Three</a></div><div id="content"><h1>+On walking</h1><p>+Walking is the oldest way to go from one place to another, and still the one with fewest rules.</p><p>+Go.</p><p>+Shoes matter less than most of us think, and weather matters more, as anyone who was out in it will tell you.</p></div><div class="sidebar"><p>-About the writer: she walks and writes about walking in many places of the world.</p></div><div id="footer">-Contact us by post</div>',
    '<div class="cookie-notice">-We use cookies to give you the best time on this site. By going on you agree to that.</div><article><header><h1>+Bread</h1></header><p>+Flour, water, salt and time are all that you need for a loaf.</p><div class="ad">-The best ovens of the year are here, with a rebate for all readers.</div><p>+Bake it hot.</p><blockquote>+Good bread needs no butter, said my father.</blockquote></article><section id="comments"><h3>-2 comments</h3><p>-Great text, I have baked it three times this week and my family loved it every time.</p><p>-Thanks!</p></section><form>-Your name -Send a comment</form>',
    '<div><a href="1">-Start</a> | <a href="2">-Shop</a> | <a href="3">-Help</a></div><p>+A page without any element that says what is what still has a text that a reader would call its main text.</p><p>+It has sentences that follow each other and that hold few links, such as this <a href="x">one</a> here.</p><p>+And one more sentence that ends the text of this page in a way that is quite plain.</p><div><a href="4">-Imprint</a> <a href="5">-Privacy</a></div>',
    '<div class="nav"><a href="1">-Latest</a></div><div><h2>+Trees of the town</h2><p>+There are oaks in the old park, and limes along the road that leads to the station.</p><p>+Plane trees stand on the square. They were planted when the square was built, long ago.</p></div><div class="related"><h3>-More like this</h3><ul><li><a href="1">-Birds of the town</a></li><li><a href="2">-Bees of the town</a></li></ul></div><div class="newsletter">-Sign up for our letter and get a new text every week in your mail box.</div>',
    '<article><p>+a</p><section><p>+Many effects are known.</p></section><address>+Rome</address><p>+A part of it.</p></article>',
    '<article><h1>+Two lines</h1><p>+One.</p><p>+Two.</p></article><aside>-Note</aside><footer>-End of page</footer>',
    '<nav>-Menu</nav><article><h1>+Links</h1><p><a href="a">+A paragraph that is nothing but a link to the source of the whole story</a></p><p>+Text after it.</p><ul><li><a href="1">+Source one</a></li></ul></article><div class="share"><a href="f">-Share</a> <a href="t">-Post</a></div>',
)


#: More labelled pages, by the words of their blocks: kind, then words or words/linked words of each block.  Each row makes
#: one page in each of the frames below, so the same blocks are seen with speaking, misleading and no markup.
SHAPED = """
menu 1/1 1/1 2/2 1/1; advert 6; head 5; text 44 3 61/2 38; foot 12
menu 1/1 1/1 1/1 2/2 1/1 1/1; advert 14; head 9; text 25; foot 14
menu 2/2 1/1 3/3; head 7; text 52 28/1 9 64; related 6/6 8/8 5/5; foot 9
menu 1/1 1/1; advert 4; head 3; text 17 2 33; related 7/7 9/9; foot 6/3
menu 4/4 2/2 1/1 1/1; notice 16; head 8; text 80 120 6 70 4 90; share 1/1 1/1 1/1; foot 11
menu 1/1 2/2 1/1; head 6; text 30 45/2 7; head 4; text 66 5 41; advert 11; related 5/5 6/6; foot 13
advert 9; menu 1/1 1/1 1/1; head 10; text 140; foot 7
head 6; text 20 31 18; foot 5
menu 1/1 1/1 1/1 1/1; head 12; text 35; advert 8; text 47 3 29; comments 13 9 4; form 2 3; foot 10
menu 2/2 2/2; text 90 75/4 60 110; foot 8/2
menu 1/1 1/1 1/1; notice 22; head 5; text 12 15 9 11; foot 16
menu 1/1 3/3 2/2; head 4; text 26 2/2 38; related 9/9 7/7 8/8 6/6; foot 12/4
menu 1/1 1/1; head 7; text 58 62 1 49; comments 21 3 17; foot 9
menu 1/1 1/1 1/1 1/1 1/1; advert 12; head 6; text 210 33 5; foot 15
menu 2/2 1/1; head 8; text 6 4 5; related 4/4; foot 4
menu 1/1 1/1 2/2; advert 7; head 11; text 71/3 64/5 55/2 48; share 1/1 2/2; form 5 2; foot 11
head 4; text 3 2 5
text 13
text 8
text 21
text 120
text 4
text 33
text 10
text 15
text 17
text 40 2
head 6; text 22 8 3
menu 1/1 1/1 2/2; head 5; text 9 14 4 2
menu 1/1 1/1; advert 9; head 3; text 31 44 6
menu 2/2 1/1 1/1; text 60 7
notice 12; head 8; text 28 5 33 3
menu 1/1 1/1 1/1; head 5; text 18/18 40; share 1/1 1/1
menu 1/1 2/2; head 4; text 30 6/6 9/9 21; foot 7
head 7; text 27 4 50; foot 5/2
menu 1/1 1/1; head 6/6; text 34 5/3 41 2; related 5/5; foot 6
menu 1/1 1/1 1/1; head 5; text 48 3; related 6/6; text 52; foot 9
menu 2/2 1/1; head 7; text 66; related 8/8; text 39 2; comments 14 6; foot 12
head 4; text 57; menu 2/2; text 24
menu 1/1 1/1; head 8; text 33 46; menu 2/2 2/2; foot 10
menu 1/1 1/1 1/1 1/1; head 6; text 1 2 4 3; foot 8
menu 1/1 1/1 1/1; advert 5; head 8; text 2 70 1 64; foot 10
menu 1/1 2/2; advert 8; head 5; text 80/4 3 55; advert 10; text 61 1; foot 7
menu 2/2 2/2 2/2; notice 18; head 9; text 37/2 45; share 1/1 1/1 1/1; comments 24 2 11; form 3 4; foot 12
menu 1/1; head 3; text 10 11 9 12 8; foot 5
menu 1/1 1/1 2/2; head 6; text 110 4/4 95; foot 9/3
head 5; text 40/2 38 1
head 6; text 24/2 51 46 2; foot 10
text 22/2 43 1
text 30 44 2
menu 3/3 2/2; head 4; text 19 1 27 3; related 7/7 8/8 6/6; foot 11/2
menu 1/1 1/1; advert 6; head 9; text 150 2 130 4; related 9/9; foot 8
menu 2/2 1/1 1/1; notice 25; advert 7; head 6; text 35 8 29; comments 30 18; foot 14
advert 11; menu 1/1 1/1 1/1; notice 15; head 5; text 41 36; form 4; foot 6
menu 1/1 1/1 1/1; head 7; text 28; head 4; text 33 2; head 3; text 47; foot 9
menu 2/2 3/3; head 5; text 60; advert 9; text 58; advert 12; text 62 3; related 6/6 5/5; foot 12
""".strip().split("\n")
#: Which kinds are main text.
MAIN = {"head": True, "text": True} | dict.fromkeys(("menu", "advert", "notice", "related", "share", "comments", "form", "foot"), False)
#: How pages hold their blocks: around the whole page, then around a kind's blocks and around each of them.
FRAMES = {
    "paragraphs": ("{}", {k: ("{}", "<h2>{}</h2>" if k == "head" else "<p>{}</p>") for k in MAIN}),
    "divisions": ("<div>{}</div>", {"head": ("{}", "<h2>{}</h2>")}),
    "loose": ("<article>{}</article>", {"head": ("{}", "<h1>{}</h1>"), "text": ("{}", "<p>{}</p>"), "menu": ("<ul>{}</ul>", "<li>{}</li>"), "related": ("<ul>{}</ul>", "<li>{}</li>"), "share": ("<p>{}</p>", "{} "), "advert": ("<div class='ad'>{}</div>", "{}"), "notice": ("<div class='notice'>{}</div>", "{}"), "comments": ("<div class='comments'>{}</div>", "<p>{}</p>"), "form": ("<form>{}</form>", "<p>{}</p>"), "foot": ("<footer>{}</footer>", "{}")}),
    "bare": ("{}", {"menu": ("<div>{}</div>", "<div>{}</div>"), "head": ("{}", "<h2>{}</h2>"), "text": ("{}", "<p>{}"), "advert": ("<div>{}</div>", "<div>{}</div>"), "notice": ("<div>{}</div>", "<div>{}</div>")}),
    "elements": ("{}", {"menu": ("<nav><ul>{}</ul></nav>", "<li>{}</li>"), "advert": ("<div class='ad'>{}</div>", "{}"), "notice": ("<div id='cookie-notice'>{}</div>", "<p>{}</p>"), "head": ("<article>{}</article>", "<h2>{}</h2>"), "text": ("<article>{}</article>", "<p>{}</p>"), "related": ("<aside class='related'>{}</aside>", "<p>{}</p>"), "share": ("<div class='share-bar'>{}</div>", "<div>{}</div>"), "comments": ("<section id='comments'>{}</section>", "<p>{}</p>"), "form": ("<form>{}</form>", "<p>{}</p>"), "foot": ("<footer>{}</footer>", "<p>{}</p>")}),
    "names": ("<div class='page has-sidebar'>{}</div>", {"menu": ("<div id='top-nav'>{}</div>", "<div>{}</div>"), "advert": ("<div class='promo'>{}</div>", "<p>{}</p>"), "notice": ("<div class='notice'>{}</div>", "<p>{}</p>"), "head": ("<div class='post'>{}</div>", "<h1>{}</h1>"), "text": ("<div class='post banner-history'>{}</div>", "<p>{}</p>"), "related": ("<div class='sidebar'>{}</div>", "<p>{}</p>"), "share": ("<div class='social'>{}</div>", "<div>{}</div>"), "comments": ("<div class='comment-list'>{}</div>", "<div>{}</div>"), "form": ("<div class='newsletter'>{}</div>", "<p>{}</p>"), "foot": ("<div id='footer'>{}</div>", "<p>{}</p>")}),
    "wrapped": ("<div class='site header-fixed'>{}</div>", {"menu": ("<nav>{}</nav>", "<div>{}</div>"), "advert": ("<div class='advert'>{}</div>", "<p>{}</p>"), "notice": ("<div class='gdpr'>{}</div>", "<p>{}</p>"), "head": ("{}", "<h1>{}</h1>"), "text": ("<article>{}</article>", "<p>{}</p>"), "related": ("<div class='related-posts'>{}</div>", "<div>{}</div>"), "share": ("<div class='share'>{}</div>", "<div>{}</div>"), "comments": ("<section class='replies'>{}</section>", "<article><p>{}</p></article>"), "form": ("<div class='signup'>{}</div>", "<p>{}</p>"), "foot": ("<footer>{}</footer>", "<div>{}</div>")}),
    "inside": ("<main>{}</main>", {"menu": ("<nav>{}</nav>", "<div>{}</div>"), "advert": ("<div class='ad-box'>{}</div>", "<p>{}</p>"), "notice": ("<div class='cookies'>{}</div>", "<p>{}</p>"), "head": ("<header>{}</header>", "<h1>{}</h1>"), "text": ("<section class='related-work'>{}</section>", "<p>{}</p>"), "related": ("<div class='related'>{}</div>", "<p>{}</p>"), "share": ("<div class='sharing'>{}</div>", "<div>{}</div>"), "comments": ("<div id='comments'>{}</div>", "<p>{}</p>"), "form": ("<form>{}</form>", "<p>{}</p>"), "foot": ("<div class='copyright'>{}</div>", "<p>{}</p>")}),
}
PLAIN = ("<div>{}</div>", "<div>{}</div>")


def shaped_pages(rows: list[str] = SHAPED, frames: tuple[str, ...] = tuple(FRAMES)) -> list[str]:
    """A page for each row and frame, with the marks + and - of ``LABELLED``."""
    out = []
    for row in rows:
        parts = [x.split() for x in row.split(";")]
        for frame in frames:
            whole, kinds = FRAMES[frame]
            page = ""
            for kind, *sizes in parts:
                around, each = kinds.get(kind, PLAIN)
                held = []
                for size in sizes:
                    n, _, k = size.partition("/")
                    words = ["word"] * int(n)
                    words[0] = ("+" if MAIN[kind] else "-") + words[0]
                    k = int(k or 0)
                    held.append(each.format(f"<a href='x'>{' '.join(words[:k])}</a> {' '.join(words[k:])}" if k else " ".join(words)))
                page += around.format("".join(held))
            out.append(whole.format(page.replace("</article><article>", "")))
    return out


def table(rows: list[str] = SHAPED) -> list[str]:
    """All labelled pages.  Those written out weigh more than the many that are made of numbers."""
    return [*LABELLED * 3, *shaped_pages(rows)]


def labelled_blocks(pages: tuple[str, ...] | list[str] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    rows, labels = [], []
    for page in pages:
        found = blocks(page)
        labels += [b[0].startswith("+") for b in found]
        rows.append(features(found))
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 3) -> tuple | bool:
    """A tree of (feature, threshold, at most, above) that splits where the Gini impurity falls most; leaves are verdicts."""
    share = y.mean()
    best = None
    if depth and 0 < share < 1:
        whole = share * (1 - share) * len(y)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                a, b = y[low], y[~low]
                if min(len(a), len(b)) >= least:
                    gain = whole - a.mean() * (1 - a.mean()) * len(a) - b.mean() * (1 - b.mean()) * len(b)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, float(cut), low)
    if best is None:
        return bool(share >= 0.5)
    _, f, cut, low = best
    below, above = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return below if isinstance(below, bool) and below is above else (f, cut, below, above)


@lru_cache(maxsize=1)
def tree() -> tuple | bool:
    return grow(*labelled_blocks(table()))


def judge(node: tuple | bool, row: np.ndarray) -> bool:
    while not isinstance(node, bool):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node


def main_text(page: str, grown: tuple | bool) -> str:
    found = blocks(page)
    return "\n".join([b[0] for b, row in zip(found, features(found), strict=True) if judge(grown, row)])


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """Add ``text``, the main text of each page."""
    grown = tree()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = batch.column(batch.schema.names.index(page)).to_pylist()
        return _with(batch, {"text": pa.array([main_text(p or "", grown) for p in pages], pa.string())})

    return df.mapInArrow(per_slice(run, df.columns.index(page)), _schema(df, [("text", T.StringType())]))
