"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text. A block's features are its word count and link density, those of the blocks before
and after it, and which kinds of container hold it. A decision tree, trained here on a small table of labelled blocks,
says which blocks belong to the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: HTML's elements by the way they cut text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head title".split())
RAW = frozenset("script style textarea title iframe".split())
#: Elements, and words of class, id or role, that hold no article text; those that hold the article.
APART = frozenset("nav header footer aside form menu dialog".split())
APART_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright dialog disqus footer form header login masthead menu modal nav navbar "
    "navigation newsletter notice notification pagination popup promo promoted promotion related reply replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
HOLDS = frozenset("article main".split())
HOLDS_WORDS = frozenset("article main content post story entry".split())
CLOSED_BY = {"p": frozenset("p"), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "tr": frozenset(["tr", "td", "th", "p"])}
#: A quote begins a value only behind an equals sign; elsewhere it is a letter like any other.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|style|aria-hidden)(?![^\s=/])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Parts of names that turn the word before them round; endings that are written together with a word.
NEGATED = frozenset("free less".split())
ENDINGS = ("list", "lists", "box", "form", "area", "section", "wrap", "wrapper", "block", "bar", "item", "items", "container", "text", "body", "left", "right", "links", "widget", "panel")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "apart", "inside", "heading", "listed")


class Block:
    __slots__ = ("parts", "linked", "apart", "inside", "heading", "listed", "text", "words", "links")

    def __init__(self, apart: bool, inside: bool, heading: bool, listed: bool):
        self.parts, self.linked = [], []
        self.apart, self.inside, self.heading, self.listed = apart, inside, heading, listed


def _parts(names: str) -> set[str]:
    """The words of class, id or role names: parts at hyphens, digits and capitals, a known ending cut off, without those that are negated."""
    out: set[str] = set()
    for name in names.split():
        parts = [x.lower() for x in re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
        for part, then in zip(parts, [*parts[1:], ""], strict=True):
            if then in NEGATED:
                continue
            out.add(part)
            for end in ENDINGS:
                if part.endswith(end) and part[: -len(end)] in APART_WORDS:
                    out.add(part[: -len(end)])
    return out


def _kinds(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(apart, holds the article, hidden) of an element by its name, class, id and role."""
    tokens: set[str] = set()
    hidden = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name in ("class", "id", "role"):
            tokens |= _parts(value)
    whole = tag in ("html", "body")
    holds = tag in HOLDS or not whole and bool(tokens & HOLDS_WORDS) and not tokens & APART_WORDS
    return tag in APART or not (whole or tag in HOLDS) and bool(tokens & APART_WORDS), holds, hidden


class _Place:
    """An open element: whether it is apart, inside the article, hidden; all as the text in it is."""

    __slots__ = ("tag", "apart", "inside", "hidden")

    def __init__(self, tag: str, apart: bool, inside: bool, hidden: bool):
        self.tag, self.apart, self.inside, self.hidden = tag, apart, inside, hidden


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page that hold text, in page order. Text of a hidden element is left out up to that element's own end."""
    found: list[Block] = []
    stack = [_Place("", False, False, False)]
    block: Block | None = None
    linked_at = at = 0  # open elements where a link began; 0 outside of links
    n = len(page)

    def put(text: str) -> None:
        nonlocal block
        if stack[-1].hidden:
            return
        if block is None:
            if not text or text.isspace():
                return
            names = {x.tag for x in stack}
            block = Block(stack[-1].apart, stack[-1].inside, bool(names & {"h1", "h2", "h3", "h4", "h5", "h6"}), bool(names & {"li", "td", "th", "dt", "dd"}))
            found.append(block)
        block.parts.append(text)
        if linked_at:
            block.linked.append(text)

    def close(tag: str) -> None:
        nonlocal linked_at
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                break
        if linked_at > len(stack):
            linked_at = 0

    while at < n:
        m = MARKUP.search(page, at)
        put(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, above = bool(m[1]), stack[-1]
        if tag in INLINE:
            if tag == "a":
                linked_at = 0 if closing else len(stack)
            if closing and above.hidden:
                close(tag)
            elif not closing and tag not in VOID and (above.hidden or _kinds(tag, m[3])[2]):
                stack.append(_Place(tag, above.apart, above.inside, True))
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in SILENT and not closing:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = n
            if tag in ("button",):
                put(" ")
            else:
                block = None if tag not in ("script", "style", "noscript") else block
            continue
        block = None
        if tag in VOID:
            continue
        if closing:
            close(tag)
            continue
        while len(stack) > 1 and stack[-1].tag in CLOSED_BY.get(tag, CLOSED_BY["p"]):
            close(stack[-1].tag)
        above = stack[-1]
        apart, holds, hidden = _kinds(tag, m[3])
        if tag == "header" and above.inside:
            apart = False  # an article's own header holds its title
        stack.append(_Place(tag, above.apart or apart, above.inside or holds, above.hidden or hidden))
    out = []
    for b in found:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        b.words = b.text.count(" ") + 1 if b.text else 0
        b.links = min(1.0, len(" ".join(b.linked).split()) / b.words) if b.linked and b.words else 0.0
        if b.text:
            out.append(b)
    return out


def features(page: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; `inside` is 1 in an article, 0 where the page has one elsewhere, 0.5 where it has none."""
    some = any(b.inside and not b.apart for b in page)
    out = np.zeros((len(page), len(FEATURES)))
    for i, b in enumerate(page):
        before, after = page[i - 1] if i else None, page[i + 1] if i + 1 < len(page) else None
        inside = float(b.inside) if some else 0.5
        out[i] = (b.words, b.links, before.words if before else 0, before.links if before else 0, after.words if after else 0, after.links if after else 0, b.apart, inside, b.heading, b.listed)
    return out


#: The labelled table: pages whose blocks marked + belong to the article and those marked - don't.
LABELLED = (
    """<body><nav><ul><li><a>-Home</a></li><li><a>-World news</a></li><li><a>-Sport</a></li></ul></nav><div class="ad">-Buy two get one free at the corner shop this week only</div>
    <article><h1>+A plain headline of some words</h1><p>+The first paragraph of a story has many words in it and goes on for a while before it ends here.</p><p>+Short.</p>
    <p>+Another paragraph follows with <a>one link</a> inside and a good number of other words around it.</p></article><footer>-Copyright example and terms of use</footer></body>""",
    """<body><header><div>-The Daily Sample</div><a>-Sign in</a></header><main><h2>+On rivers</h2><p>+Rivers run from high to low ground and carry water, sand and stones towards the sea over many years.</p>
    <ul><li>+Upper course</li><li>+Middle course</li></ul><aside>-Most read this week: ten tips for your garden and more for you</aside><p>+Yes.</p><form>-Your e-mail address please</form></main>
    <section class="comments">-I liked this text very much and will come back again to read the next one soon<div>-Me too</div></section></body>""",
    """<body><div class="menu"><a>-Start</a> <a>-Shop</a> <a>-Help</a></div><div id="cookie-notice">-We use cookies to make this site work better for all of our visitors</div><div class="wrap"><h1>+Bread at home</h1>
    <p>+Mix the flour with water and salt, let it rest for some hours, fold it and bake it in a very hot oven until brown.</p><p>+Let the loaf cool down on a rack before you cut it, for the crumb needs time to set fully.</p></div>
    <div><a>-Next page</a></div><div class="sidebar">-Popular posts of the month and an archive of older texts on baking</div><footer>-All rights reserved</footer></body>""",
    """<body><div><a>-Index</a> | <a>-Search</a> | <a>-About us</a></div><div><p>+It was late when the train left the station, and the few people on board were tired and did not talk at all.</p>
    <p>+Outside the snow kept falling, and the lights of the villages went by slowly, one after the other, like boats.</p><p>+Nobody spoke.</p><p>+In the morning they had arrived, and the town lay white and still below the hill.</p></div>
    <div><a>-Imprint</a> <a>-Privacy</a> <a>-Contact</a></div><div>-Page 3</div></body>""",
    """<body><article><header><h1>+News of the harbour</h1></header><p>+No.</p><p>+Two ships came in during the night with grain on board.</p><div class="share">-Tell your friends</div><p>+<a>A paragraph that is a link as a whole</a></p><blockquote>+We were glad to see land.</blockquote>
    <div class="advert">-Cheap ferries all year round, book now and save a lot of money on the way</div><p>+They leave on Monday.</p><div class="related"><a>-More about ships</a><a>-More about grain</a></div></article><div>-A long line outside of the article that says nothing about it but has many words</div></body>""",
    """<body><header>-Site name and a slogan that is rather long for what it says</header><div class="content"><h1>+Title</h1><p>+Text</p><p>+More text of a few words</p><table><tr><td>+Cell one</td><td>+Cell two</td></tr></table></div><div>-Last changed today</div><div>-Some closing words of the site which are the same on every page that it has</div></body>""",
    """<body><div><a><div>-Home</div></a><a><div>-Shop</div></a></div><div id="commentlist"><p>-Nice text, I read it all and sent it to a friend of mine who likes such things too</p></div>
    <div class="ad-free-story"><h2>+Salt</h2><p>+Salt was dear once, for it kept meat and fish through the winter and had to be brought from far away by cart.</p><p>+See the <a>old road</a> too.</p></div>
    <div><a><p>-Another story that you may like</p></a><a><p>-One more story from our archive of stories</p></a></div><div>-Terms</div></body>""",
    """<body><table><tr><td><a>-News</a></td><td><a>-Maps</a></td></tr></table><div><h3>+The mill</h3><p>+The mill stands by the brook, and its wheel has not turned for thirty years, yet the miller's house is still lived in.</p>
    <p>+<a>A short note on mills</a> is kept in the hall, where guests may read it while they wait for their bread to be baked.</p><p>+Old stones.</p><p>+They were cut in the hills and came down the river on rafts in the spring, when the water was high.</p></div><div><a>-Back to the start</a></div></body>""",
    """<article><p>+Alone</p></article>""",
    """<body><nav><a>-Up</a></nav><article><h1>+A name</h1><p>+Few words here</p><p>+And the page is cut off""",
    """<p>+A page that is nothing but one paragraph of text, without any menu before it or footer after it, is all article.</p>""",
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled blocks."""
    rows, labels = [], []
    for page in LABELLED:
        got = blocks(page)
        rows.append(features(got))
        labels += [b.text.startswith("+") for b in got]
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A tree of (feature, bound, tree up to the bound, tree beyond it), split by the least Gini impurity; a leaf is a bool."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best: tuple = (np.inf,)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bound
            impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if impurity < best[0] - 1e-12:
                best = impurity, f, float(bound)
    if best[0] >= len(y) * share * (1 - share) - 1e-12:
        return bool(share >= 0.5)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def trained():
    return grow(*labelled_table())


def decide(tree, row: np.ndarray) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree=None) -> str:
    """The article's blocks joined by a space; nothing within them is left out."""
    if not page:
        return ""
    tree = trained() if tree is None else tree
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html gives an empty text, and so does a page without article; truncated pages are read as far as they go.
    Repeated rows and null ids give a row each; an empty table gives no rows; other columns are ignored.
    """
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
