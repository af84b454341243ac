"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks.  Each block has its word count and link density,
those of the blocks before and after it, the kind of its tag, the kinds of the
elements around it (article, navigation, ...) and a weight of the class names and ids around
it that is learnt, like the tree, from the labelled pages.  A small CART, trained on the
blocks of ``LABELLED``, says which blocks are main text; those are joined in page order.

Defined results: null and empty html give an empty text; broken markup is read as far as it
goes (a cut-off tag at the end is no text; a control or noscript without an end tag ends at
the next tag of a block); texts of any length are read whole, in time that grows with their
length; rows with equal html get equal texts, a row each; an empty table gives no rows; other
columns are kept by ``extract``, whatever their names (the new one gets underscores if its name is taken).
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _shared as S

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no markup and no text of the page; without an end tag they go on to the page's end.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "template"}
#: Elements that are passed over up to their end tag if it comes before another of their kind.
CONTROLS = {"noscript", "button", "select", "datalist", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
ITEMS = {"li", "td", "th", "dd", "dt", "option"}
#: What elements and ARIA roles are by the HTML standard: the page's own text, or something beside it.
OWN = {"article", "main"}
BESIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "navigation", "contentinfo", "complementary", "search", "banner", "alertdialog"}
#: A whole page or article may stand inside these.
AROUND = {"form", "fieldset"}
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "words_around", "links_around", "linked_run",
    "own", "beside", "own_on_page", "marks", "heading", "paragraph", "item", "sentence", "share_of_longest",
)
NEIGHBOURS = tuple(i for i, f in enumerate(FEATURES) if f.endswith(("_before", "_after", "_around", "_run")))


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    own: bool  # inside an article or main element
    beside: bool  # inside navigation, footer, form, ...
    marks: frozenset[str]  # words of the class names and ids around it
    tag: str


class _Open:
    __slots__ = ("beside", "marks", "own", "soft")

    def __init__(self, own: bool = False, beside: bool = False, soft: bool = False, marks: frozenset[str] = frozenset()) -> None:
        self.own, self.beside, self.soft, self.marks = own, beside, soft, marks


def _opened(name: str, attributes: str, above: _Open) -> _Open:
    """An element's state from its kind and attributes and the element around it; ``soft``: only a form is around it."""
    kinds, marks, hidden = {name}, above.marks, False
    if attributes.strip() and name not in ("html", "body"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
        kinds |= set(found.get("role", "").lower().split())
        kinds |= {"article"} if found.get("itemprop", "").lower() == "articlebody" else set()
        words = {w for key in ("class", "id") for w in SPLIT.split(CAMEL.sub("-", found.get(key, "")).lower()) if w}
        marks = marks | words if words else marks
    if kinds & OWN and not hidden:
        inside = above.beside and not above.soft
        return _Open(not inside, inside, False, marks)
    hard = hidden or bool(kinds & (BESIDE - AROUND)) or name == "header" and not above.own
    beside = above.beside or hard or bool(kinds & AROUND)
    return _Open(above.own, beside, beside and not hard and (above.soft or not above.beside), marks)


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, _Open]] = [("", _Open())]
    parts: list[str] = []
    link_words, in_link = 0, False
    at, end = 0, len(page)

    def text(raw: str) -> None:
        nonlocal link_words
        if raw:
            parts.append(raw)
            if in_link:
                link_words += len(raw.split())

    def flush() -> None:
        nonlocal link_words, in_link
        if parts:
            joined = "".join(parts)
            words = (html.unescape(joined) if "&" in joined else joined).split()
            if words:
                name, top = stack[-1]
                out.append(Block(" ".join(words), len(words), min(link_words, len(words)), top.own, top.beside, top.marks, name))
            parts.clear()
        link_words, in_link = 0, False

    def close(name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    while at < end:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, start)
        if not m:  # a lone "<" is text, unless a tag is cut off there
            text(page[at : start + 1] if start + 1 < end else page[at:start])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attributes = (m[3] if m[2] else m[6]) or ""
        if name in RAW:
            if not closing:
                done = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = done.end() if done else end
                if name in ("textarea", "iframe"):
                    flush()
        elif name in CONTROLS:
            if not closing and not attributes.rstrip().endswith("/"):
                flush()
                # Up to the next tag of its kind; if that opens another, or there is none, up to the next block's tag.
                done = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if done and done[1]:
                    at = done.end()
                else:
                    nearest = BLOCK_TAG.search(page, at)
                    at = nearest.start() if nearest else end
        elif name == "br":
            parts.append("\n")
        elif name == "a":
            in_link = not closing
        elif name in BLOCK or "-" in name:
            flush()
            if closing:
                close(name)
            else:
                if stack[-1][0] == "p" or name in ITEMS | {"tr"} and stack[-1][0] == name:
                    stack.pop()
                if name not in VOID:
                    stack.append((name, _opened(name, attributes, stack[-1][1])))
    flush()
    return out


BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)


def _around_all(own: Sequence[Block]) -> frozenset[str]:
    """Words of class names and ids that tell nothing: they are around the whole article and nearly all of the page."""
    inside = [b for b in own if b.own and not b.beside] or own
    if len(own) < 4 or not all(b.marks for b in inside):
        return frozenset()
    words = sum(b.words for b in own)
    common = frozenset.intersection(*(b.marks for b in inside))
    return frozenset(w for w in common if 5 * sum(b.words for b in own if w in b.marks) >= 4 * words)


def features(own: Sequence[Block], odds: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each block; ``odds``: the learnt weights of words in class names and ids."""
    x = np.zeros((len(own), len(FEATURES)))
    if not len(own):
        return x
    words = np.array([b.words for b in own], float)
    links = np.array([b.link_words for b in own]) / words
    x[:, 0], x[:, 1] = words, links
    x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
    # The two blocks before and the two after, together.
    pad = np.zeros(2)
    total, linked = np.r_[pad, words, pad], np.r_[pad, links * words, pad]
    x[:, 6] = total[:-4] + total[1:-3] + total[3:-1] + total[4:]
    x[:, 7] = (linked[:-4] + linked[1:-3] + linked[3:-1] + linked[4:]) / np.maximum(x[:, 6], 1)
    # How many blocks in a row, with this one, are mostly links.
    most = links > 0.5
    run = np.cumsum(np.r_[True, most[1:] != most[:-1]]) - 1
    x[:, 8] = np.bincount(run)[run] * most
    x[:, 9] = [b.own for b in own]
    x[:, 10] = [b.beside for b in own]
    x[:, 11] = any(b.own and not b.beside for b in own)
    wide = _around_all(own)
    x[:, 12] = [sum(odds.get(w, 0.0) for w in b.marks if w not in wide) if b.marks else 0.0 for b in own]
    x[:, 13] = [b.tag[:1] == "h" and b.tag[1:].isdigit() for b in own]
    x[:, 14] = [b.tag in ("p", "blockquote", "pre") for b in own]
    x[:, 15] = [b.tag in ITEMS for b in own]
    x[:, 16] = [b.text[-1:] in ".!?…:;\"»”" for b in own]
    x[:, 17] = words / words.max()
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4) -> list[tuple[int, float, int, int, float]]:
    """A CART of (feature, threshold, left, right, share of main text); feature -1: a leaf."""
    nodes: list = []

    def add(rows: np.ndarray, left: int) -> int:
        k, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, 0, 0, share))
        best = (share * (1 - share) * len(rows) - 1e-9, None)
        if left and len(rows) >= 2 * least and 0 < share < 1:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, t = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                cut = cut[(cut >= least) & (len(v) - cut >= least)]
                if not len(cut):
                    continue
                a, b = t[cut - 1], t[-1] - t[cut - 1]
                impurity = a * (1 - a / cut) + b * (1 - b / (len(v) - cut))
                i = int(impurity.argmin())
                if impurity[i] < best[0] - 1e-9:
                    best = (float(impurity[i]), (f, float((v[cut[i]] + v[cut[i] - 1]) / 2)))
        if best[1]:
            f, threshold = best[1]
            low = x[rows, f] <= threshold
            nodes[k] = (f, threshold, add(rows[low], left - 1), add(rows[~low], left - 1), share)
        return k

    add(np.arange(len(y)), depth)
    return nodes


def decide(nodes: Sequence[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    f, t, left, right, share = (np.array(c) for c in zip(*nodes))
    for _ in range(len(nodes)):
        inner = f[at] >= 0
        if not inner.any():
            break
        go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
        at = np.where(inner, np.where(go, left[at], right[at]), at)
    return share[at] > 0.5


#: Pages labelled by hand.  {+12.} is a run of 12 words of main text with a full stop, {-3} one of 3 words that is none.
LABELLED = (
    "<header class=site-header><a>{-2}</a><p>{-6}</p></header><nav><ul><li><a>{-1}</a><li><a>{-1}</a><li><a>{-2}</a></ul></nav><div class=cookie-bar>{-14.}</div><article><h1>{+7}</h1><p>{+60.}</p><p>{+25.}</p><p>{+2.}</p><aside><h3>{-2}</h3><p>{-18.}</p></aside><p>{+44.}</p></article><footer>{-9.}</footer>",
    "<nav><a>{-1}</a></nav><nav><ul><li><a>{-1}</a><li><a>{-1}</a><li><a>{-1}</a></ul></nav><div class=ad>{-12.}</div><article><h1>{+9.}</h1><p>{+150.}</p><p>{+3.}</p><p>{+90}</p></article><footer>{-20.}</footer>",
    "<main><div class=entry-header><h1>{+5}</h1></div><section><h2 class=section-header>{+3}</h2><p>{+80.}</p><ul><li>{+6}</li><li>{+4}</li><li>{+9.}</li></ul></section><section class=section-header-note><h2>{+2}</h2><p>{+12.}</p></section></main><footer class=site-footer><p>{-30.}</p><a>{-2}</a></footer>",
    "<article><h1>{+4}</h1><p>{+70.}</p><p>{+33.}</p><section id=comments><h2>{-2}</h2><article><p>{-30.}</p></article><article><p>{-4.}</p></article></section></article>",
    "<div role=main><h1>{+6}</h1><p>{+40.}</p><p>{+55.}</p><div class=comment-list><h3>{-2}</h3><div class=comment><b>{-2}</b><p>{-45.}</p></div><div class=comment><p>{-9}</p></div></div><div class=respond><form><label>{-2}</label></form></div></div>",
    "<article><h1>{+8}</h1><p>{+66.}</p><p>{+20.}</p><p><a>{-6}</a></p><p><a>{-8}</a></p><p><a>{-5}</a></p><p><a>{-7}</a></p></article>",
    "<article><p>{+30.}</p><p><a>{+5}</a></p><p>{+50.}</p><p>{+8}<a>{+2}</a>{+9.}</p><blockquote>{+15.}</blockquote><p><a>{+1}</a>{+4.}</p><p>{+38.}</p></article>",
    "<div class=wrapper><div class=menu><div><a>{-1}</a></div><div><a>{-2}</a></div><div><a>{-1}</a></div></div><div class=content><h1>{+6}</h1><p>{+48.}</p><p>{+72.}</p><p>{+5.}</p></div><div class=sidebar><h4>{-2}</h4><p>{-25.}</p><p><a>{-3}</a></p></div><div class=footer>{-12}</div></div>",
    "<div><p>{+2.}</p><p>{+2.}</p></div>",
    "<p>{+4.}</p><p>{+9}</p>",
    "<h1>{+3}</h1><p>{+6.}</p>",
    "<div><a>{-1}</a> | <a>{-1}</a> | <a>{-2}</a></div><h1>{+6}</h1><p>{+40.}</p><p>{+8.}</p><p>{+64.}</p><div><a>{-2}</a> <a>{-2}</a></div><div>{-4}</div>",
    "<ul><li><a>{-1}</a><li><a>{-2}</a><li><a>{-1}</a><li><a>{-2}</a></ul><div><div>{+90.}</div><div>{+30.}</div></div><h3>{-2}</h3><ul><li><a>{-4}</a><li><a>{-5}</a><li><a>{-3}</a></ul><div>{-5}</div>",
    "<table><tr><td><a>{-2}</a><td><a>{-1}</a></tr></table><h2>{+4}</h2>{+70.}<br>{+20.}<p>{+35.}</p><h2>{+3}</h2><p>{+22.}</p><p><a>{-1}</a> <a>{-1}</a> <a>{-1}</a></p><p>{-3}</p>",
    "<article><h1>{+5}</h1><figure><figcaption>{+7}</figcaption></figure><p>{+35.}</p><pre>{+20}</pre><table><tr><td>{+1}<td>{+2}</tr><tr><td>{+1}<td>{+3}</tr></table><dl><dt>{+1}<dd>{+9.}</dl><p>{+28.}</p></article>",
    "<article><h1>{+7}</h1><div class='share social'><a>{-1}</a> <a>{-1}</a> <a>{-1}</a></div><p>{+52.}</p><div class='advert'>{-10.}</div><p>{+31.}</p><div class='newsletter signup'><p>{-12.}</p></div><p>{+6.}</p><div class='related posts'><h3>{-2}</h3><p><a>{-6}</a></p><p><a>{-5}</a></p></div></article>",
    "<main class=page-content><h1>{+4}</h1><p>{+45.}</p><div class='ad sponsored'><p>{-22.}</p></div><p>{+60.}</p><div class='promo banner'>{-8.}</div><p>{+17.}</p></main><div class=sidebar-content><p>{-40.}</p></div><div class=footer-content><p>{-16.}</p></div>",
    "<div id=cookie-consent class='notice banner'><p>{-24.}</p></div><div class='page content'><h1>{+5}</h1><p>{+38.}</p><p>{+52.}</p></div><div class='sidebar widget'><p>{-28.}</p></div><div id=footer><p>{-14.}</p></div>",
    "<article><h1>{+6}</h1><section id=search-strategy><h2>{+2}</h2><p>{+47.}</p></section><section class=notice-and-discussion><h2>{+3}</h2><p>{+39.}</p></section><section id=related-work><p>{+55.}</p></section></article><div id=search-box><p>{-3}</p></div>",
    "<div class=breadcrumb><a>{-1}</a> / <a>{-1}</a> / {-2}</div><div class='post content'><h1>{+7}</h1><p>{+33.}</p><p>{+41.}</p></div><div class='comments comment-list'><h3>{-2}</h3><p>{-26.}</p><p>{-12.}</p></div><div class=pagination><a>{-1}</a><a>{-1}</a></div>",
    "<nav><a>{-1}</a> <a>{-1}</a></nav><footer><p>{-11.}</p><p><a>{-2}</a></p></footer>",
    "<form id=page><div><a>{-1}</a><a>{-1}</a></div><article><h1>{+5}</h1><p>{+36.}</p><p>{+3.}</p></article><div><label>{-2}</label></div></form>",
    "<div class=post-content><p>{+58.}</p><p>{+4.}</p><p>{+27.}</p><div class='advertisement'><p>{-9.}</p></div><p>{+49.}</p></div><div class=recommended><p><a>{-6}</a></p><p><a>{-7}</a></p></div>",
    "<div><h2>{+2}</h2><p>{+21.}</p><p>{+3.}</p><p>{+34.}</p></div><form><p>{-5}</p><p>{-9.}</p></form><div class=copyright>{-6}</div>",
    "<div class=popup><p>{-11.}</p></div><div class=modal><h3>{-4}</h3><p>{-19.}</p></div><article class=post><header><h1>{+6}</h1></header><p>{+43.}</p><footer>{-5}</footer></article><div class=alert>{-7.}</div>",
    "<article><h1>{+5}</h1><p>{+29.}</p><ul><li>{+3}</li><li><a>{+2}</a>{+5}</li><li>{+7.}</li></ul><p>{+11.}</p><ul><li><a>{-3}</a></li><li><a>{-4}</a></li><li><a>{-3}</a></li><li><a>{-5}</a></li></ul></article>",
    "<article><h1>{+2}</h1><p>{+90.}</p><p>{+2}</p><p>{+70.}</p><ul><li><a>{-5}</a></li><li><a>{-6}</a></li><li><a>{-3}</a></li></ul></article><div><a>{-1}</a></div>",
    "<article><p>{+55.}</p><p>{+1}</p><p>{+62.}</p><p><a>{-8}</a></p><p><a>{-4}</a></p><p><a>{-6}</a></p></article><p>{-7.}</p>",
    "<article><p>{+14}</p><p>{+100.}</p><p><a>{+6}</a></p><p>{+75.}</p><p>{+3}</p><p><a>{+9}</a></p><p>{+40.}</p></article>",
    "<div><p>{+44.}</p><p>{+2.}</p><p>{+63.}</p></div><div><p><a>{-5}</a></p><p><a>{-3}</a></p><p><a>{-4}</a></p></div><p>{-4}</p>",
    "<nav><a>{-1}</a><a>{-2}</a></nav><article><h1>{+3}</h1><p>{+2}<a>{+2}</a></p><p>{+30.}</p><p>{+1}<a>{+1}</a></p><p>{+2.}</p></article>",
    "<article><h1>{+4}</h1><p>{+1.}</p></article>",
    "<article><p>{+3}<a>{+2}</a>{+1.}</p><p>{+2}<a>{+2}</a></p><p>{+1}</p></article>",
    "<nav><ul><li><a>{-1}</a></ul></nav><article><h2>{+2}</h2><p>{+2.}</p><h2>{+1}</h2><p>{+80.}</p><p>{+1}</p></article>",
    "<main><p>{+70.}</p><p>{+8.}<a>{+6}</a></p><div>{+2}</div><p>{+4}<a>{+3}</a></p></main>",
    "<article><section><p>{+3}</p><p>{+60.}</p></section><section><h3>{+2}</h3><p>{+2}<a>{+1}</a></p><p>{+5.}</p></section></article><footer>{-3}</footer>",
    "<div><h2>{+3}</h2><p>{+3}</p><p>{+24.}</p><p>{+1}</p></div>",
    "<div><a>{-6}</a></div><div><a>{-5}</a></div><div><a>{-9}</a></div><p>{+50.}</p><p><a>{+2}</a></p><p>{+7.}</p><p>{+31.}</p><p><a>{+3}</a></p><p>{+12.}</p>",
    "<article><ul><li><a>{-7}</a></li><li><a>{-5}</a></li><li><a>{-6}</a></li><li><a>{-8}</a></li></ul><p>{+90.}</p><p>{+8.}</p><p><a>{+3}</a></p><p>{+6.}</p><p>{+61.}</p></article>",
    "<article><p>{+26.}</p><p><a>{+2}</a></p><p>{+4.}</p><p><a>{+10}</a></p><h2>{+3}</h2><p>{+58.}</p><p><a>{-5}</a></p><p><a>{-10}</a></p><p><a>{-6}</a></p></article>",
    "<p><a>{-1}</a></p><p><a>{-3}</a></p><p><a>{-2}</a></p><p>{-2}</p><p><a>{-2}</a></p><p>{+37.}</p><p>{+3}</p><p>{+29.}</p><p>{+3}<a>{+2}</a>{+8.}</p>",
    "<article><h1>{+5}</h1><p>{+9}<a>{+4}</a></p><p>{+45.}</p><p>{+14}<a>{+5}</a>{+3.}</p><p>{+70.}</p><p>{+3}<a>{+2}</a></p><p>{+33.}</p></article>",
    "<nav><a>{-1}</a> <a>{-2}</a></nav><article><p>{+5.}</p></article><footer><a>{-2}</a></footer>",
    "<div><a>{-2}</a></div><div><a>{-1}</a></div><article><p>{+2}</p><p>{+3.}</p></article><div><a>{-2}</a></div><div><a>{-2}</a></div>",
    "<nav><ul><li><a>{-1}</a><li><a>{-2}</a></ul></nav><main><h1>{+1}</h1></main><div><a>{-2}</a></div>",
    "<article><p>{+60.}</p><p>{+30.}</p><p><a>{+4}</a></p><p>{+2.}</p><p>{+3}</p><p><a>{+6}</a></p><p>{+1.}</p></article><div><a>{-3}</a></div>",
    "<form><div><a>{-1}</a></div><article><p>{+4.}</p></article></form>",
    "<nav><a>{-1}</a><a>{-1}</a></nav><main><p>{+8}</p></main>",
)
RUN = re.compile(r"\{([+-])(\d+)(\.?)\}")


def labelled_page(page: str, r: random.Random | None = None) -> tuple[str, list[bool]]:
    """The html of a page in the notation of ``LABELLED`` and for each of its blocks whether it is main text.

    With ``r`` long runs get some other number of words.
    """

    def run(m: re.Match) -> str:
        n = int(m[2]) if r is None or int(m[2]) < 6 else max(5, round(int(m[2]) * r.uniform(0.7, 1.4)))
        return " " + " ".join(["yes" if m[1] == "+" else "no", *["word"] * (n - 1)]) + m[3] + " "

    made = RUN.sub(run, page)
    return made, [b.text.replace("|", "").replace("/", "").split()[0].rstrip(".") == "yes" for b in blocks(made)]


def labelled_table(pages: Sequence[str] = LABELLED, copies: int = 4, seed: int = 7) -> tuple[list[list[Block]], np.ndarray]:
    """The training table: the blocks of each labelled page, some times with other lengths, and all their labels."""
    r, own, labels = random.Random(seed), [], []
    for k in range(copies):
        for page in pages:
            made, y = labelled_page(page, r if k else None)
            own.append(blocks(made))
            labels += y
    return own, np.array(labels, float)


def learn_odds(pages: Sequence[list[Block]], labels: np.ndarray) -> dict[str, float]:
    """For each word of class names and ids the log ratio of the pages where it is around main text and where around other text."""
    seen: dict[str, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    at = 0
    for own in pages:
        page = hash(tuple(b.marks for b in own))  # copies of a page count once
        for b in own:
            for w in b.marks:
                seen[w][int(labels[at] < 0.5)].add(page)
            at += 1
    return {w: math.log((len(main) + 0.5) / (len(other) + 0.5)) for w, (main, other) in seen.items()}


@dataclass
class Classifier:
    """A tree over FEATURES and the weights of words in class names and ids; ``used``: features that are not set to zero."""

    nodes: list
    odds: dict[str, float]
    used: np.ndarray

    def keep(self, own: Sequence[Block]) -> np.ndarray:
        return decide(self.nodes, features(own, self.odds) * self.used)


def train(pages: Sequence[str] = LABELLED, without: Sequence[int] = ()) -> Classifier:
    own, y = labelled_table(pages)
    odds, used = learn_odds(own, y), np.ones(len(FEATURES))
    used[list(without)] = 0
    return Classifier(grow(np.concatenate([features(b, odds) for b in own]) * used, y), odds, used)


_classifier: Classifier | None = None


def classifier() -> Classifier:
    global _classifier
    if _classifier is None:
        _classifier = train()
    return _classifier


def main_text(page: str | None, by: Classifier | None = None) -> str:
    own = blocks(page)
    if not own:
        return ""
    return " ".join(b.text for b, k in zip(own, (by or classifier()).keep(own)) if k)


def extract(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each page. No shuffle; the tree and the weights go with the tasks."""
    by = classifier()
    inner, back = S.aside(pages, html_col)

    @F.pandas_udf("string")
    def run(column):
        import pandas as pd

        return pd.Series([main_text(p if isinstance(p, str) else None, by) for p in column], dtype=object)

    return back(inner.withColumn(out, run(F.col(f"`{html_col}`"))), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.pick(S.table(spark, sf_dir, "pages"), "page_id", "url", "html")
    out = extract(pages).select("page_id", "url", F.col("main_text").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


#: The tables' pages have their main text in one article element of plain paragraphs: there its text can be had by replacing tags.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS inside FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(inside, '(?s)<!--.*?-->', '', 'g'), '</?(?:p|h1|br)>', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g') AS bare FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(bare, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
