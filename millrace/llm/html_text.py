"""Main text of HTML pages: boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

Each element has features: the density and amount of text and links in its subtree, its tag, depth, place among
its siblings, and the attribute tokens of itself and its ancestors.  The trees give the log odds that an element
belongs to the article; the decoder chooses the labels of most total score under the constraint that below a
dropped element all is dropped (one pass up, one down).  The model is fitted on labelled pages that `lesson` writes
(LESSONS of them, a fixed bound), with a fixed seed, so every run has the same model.

Edge cases: a null or empty page, or one without an article, has an empty text; unclosed and stray tags are closed
by what follows; a declaration or comment that never ends hides the rest, a tag that never ends is text; repeated
rows are extracted each for itself; pages of any length are read whole, in time in proportion to their length; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import table

LESSONS = 500

# The elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset("script style noscript template textarea select iframe object svg math canvas audio video head title button datalist".split())
RAW = ("script", "style", "textarea", "title", "iframe")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag of the same group closes, up to the element that holds the group.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop|data-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
TAGS = ("html", "body", "div", "section", "p", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "a", "table", "blockquote", "figure", "h1", "h2", "h3", "pre", "dl")


@dataclass
class Page:
    """The elements of a page in document order, and its pieces of text: (element, text, begins a block)."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    label: list[str | None] = field(default_factory=list)
    text: list[tuple[int, str, bool]] = field(default_factory=list)


def _tokens(source: str) -> Iterator[tuple[str | None, bool, str]]:
    """(name, whether it ends, attributes) of each tag, (None, False, text) of each piece of text.

    After a raw element's start tag its contents are left out.  Quotes hide the end of a tag unless one never closes.
    """
    at, n, quotes = 0, len(source), True
    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            yield None, False, source[at:]
            return
        if begin > at:
            yield None, False, source[at:begin]
        if source.startswith(("<!", "<?"), begin):
            end = source.find("-->", begin + 4) if source.startswith("<!--", begin) else source.find(">", begin)
            if end < 0:
                return
            at = end + (3 if source[end] == "-" else 1)
            continue
        m = _NAME.match(source, begin + 1)
        if not m:
            yield None, False, "<"
            at = begin + 1
            continue
        end = _INSIDE.match(source, m.end()).end() if quotes else n
        if end == n or source[end] != ">":
            # a quote is open to the end, so from here on quotes hide nothing
            quotes, end = False, source.find(">", m.end())
        if end < 0:
            yield None, False, source[begin:]
            return
        name, at = m[2].lower(), end + 1
        yield name, bool(m[1]), source[m.end() : end]
        if name in _RAW_END and not m[1]:
            stop = _RAW_END[name].search(source, at)
            at = source.find(">", stop.end()) + 1 if stop else 0
            if not at:
                return


class _Open:
    """The open elements of a page, with where each tag stands among them."""

    def __init__(self, page: Page):
        self.page, self.stack, self.unread = page, [0], 0
        self.places: dict[str, list[int]] = defaultdict(list)
        #: For each open element the nearest at or below it that is not inline.
        self.block = [0]

    def push(self, element: int, name: str) -> None:
        self.places[name].append(len(self.stack))
        self.block.append(self.block[-1] if name in INLINE else len(self.stack))
        self.stack.append(element)
        self.unread += name in UNREAD

    def close(self, down_to: int) -> None:
        while len(self.stack) > down_to:
            name = self.page.tag[self.stack.pop()]
            self.places[name].pop()
            self.block.pop()
            self.unread -= name in UNREAD

    def make_room(self, name: str) -> None:
        """Close what a block's start ends: an open paragraph, the head, or the item before an item."""
        ends, holders = CLOSES.get(name, ((), ()))
        if not ends:
            k = self.block[-1]
            tag = self.page.tag[self.stack[k]]
            if k and (tag == "p" or tag == "head" and name == "body"):
                self.close(k)
            return
        holder = max([0, *(self.places[h][-1] for h in holders if self.places[h])])
        ended = [places[k] for t in (*ends, "p") if (k := bisect_right(places := self.places[t], holder)) < len(places)]
        if ended:
            self.close(min(ended))


def parse(source: str) -> Page:
    page = Page(["html"], [-1], [()], [None], [])
    open_, apart = _Open(page), True
    for name, ends, rest in _tokens(source):
        if name is None:
            if not open_.unread:
                page.text.append((open_.stack[-1], rest, apart))
                apart = False
            continue
        if ends:
            if open_.places[name]:
                open_.close(open_.places[name][-1])
            apart = apart or name not in INLINE
            continue
        if name in VOID:
            apart = apart or name in ("br", "hr")
            continue
        if name in ("html", "body") and len(page.tag) > 1 and (open_.places[name] or name == "html"):
            continue
        if name not in INLINE:
            apart = True
            open_.make_room(name)
        names, label = (), None
        if rest and not rest.isspace():
            found = _ATTR.findall(rest)
            label = next((v.strip("\"'") for k, v in found if k == "data-label"), None)
            names = tuple(w for k, v in found if k != "data-label" for w in (_WORD.findall(v.lower()) if v and k.lower() in ("class", "id", "role", "itemprop") else [k.lower()]))
        page.tag.append(name)
        page.parent.append(open_.stack[-1])
        page.names.append(names)
        page.label.append(label)
        if name not in _RAW_END and not rest.endswith("/"):
            open_.push(len(page.tag) - 1, name)
    return page


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """A row for each element."""
    n = len(page.tag)
    parent = page.parent
    own, links, words, stops, tags = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
    for i, text, _ in page.text:
        size = len(text) - text.count(" ")
        own[i] += size
        words[i] += text.count(" ")
        stops[i] += text.count(".") + text.count(",")
    total = own[:]
    depth, child, children, low, high, mine, kin = [0] * n, [0] * n, [0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    under: list[int] = [0] * n
    for i in range(n):
        p = parent[i]
        mine[i] = sum(odds.get(w, 0.0) for w in page.names[i])
        t = page.tag[i]
        bad = t in ("nav", "footer", "aside", "form", "header")
        if p >= 0:
            depth[i] = depth[p] + 1
            child[i] = children[p]
            children[p] += 1
            low[i], high[i] = min(low[p], mine[i]), max(high[p], mine[i])
            under[i] = (under[p] | (1 if bad else 0)) | (2 if t in ("article", "main") else 0)
            if t == "a":
                links[i] = 1
    linked = [own[i] if page.tag[i] == "a" else 0 for i in range(n)]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        words[p] += words[i]
        stops[p] += stops[i]
        tags[p] += tags[i]
        links[p] += links[i]
        linked[p] += total[i] if page.tag[i] == "a" else linked[i]
        kin[p] += page.tag[i] == "p"
    f = np.array([total, own, linked, words, stops, tags, links, depth, child, children, mine, low, high, under, kin], np.float64).T
    up = np.array([max(p, 0) for p in parent])
    t = f[:, 0]
    tag = np.array([[x == y for y in TAGS] for x in page.tag], np.float64)
    more = [t / f[:, 5], f[:, 2] / np.maximum(t, 1), f[:, 4] / np.maximum(f[:, 3], 1), t / np.maximum(t[up], 1), t / max(t[0], 1), f[up, 9], f[:, 8] / np.maximum(f[up, 9], 1), f[up, 10], f[:, 14] / np.maximum(f[:, 9], 1)]
    return np.column_stack([f[:, :14], *more, tag, tag[up][:, [2, 3, 5, 6]]])


def decode(page: Page, scores: np.ndarray) -> np.ndarray:
    """The labels of most total score such that nothing below a dropped element is kept."""
    n = len(page.tag)
    keep, drop = (-np.logaddexp(0, -scores)).tolist(), (-np.logaddexp(0, scores)).tolist()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = np.zeros(n, bool)
    for i in range(n):
        p = page.parent[i]
        out[i] = (p < 0 or out[p]) and keep[i] >= drop[i]
    return out


def extract(source: str, model: tuple[BoostedTrees, dict[str, float]]) -> str:
    trees, odds = model
    page = parse(source)
    return _text(page, decode(page, trees.scores(features(page, odds))))


def _text(page: Page, kept: np.ndarray) -> str:
    pieces = []
    for i, text, apart in page.text:
        if apart:
            pieces.append(" ")
        if kept[i]:
            pieces.append(text)
    return " ".join(html.unescape("".join(pieces)).split())


# ---- labelled pages ------------------------------------------------------------------------------------------

# Names that sites give the parts of a page.
PARTS = {
    "menu": ("nav menu navbar navigation topnav mainmenu", "nav"),
    "header": ("header masthead banner branding site-header topbar", "header"),
    "footer": ("footer site-footer colophon bottom copyright legal", "footer"),
    "sidebar": ("sidebar aside rail widget secondary widgets", "aside"),
    "advert": ("ad ads advert advertisement sponsor sponsored promo banner-ad adsense", "div"),
    "notice": ("cookie notice consent gdpr banner alert popup modal cookie-notice", "div"),
    "form": ("form newsletter subscribe signup login search search-form", "form"),
    "comments": ("comments comment-list responses discussion replies comment", "section"),
    "related": ("related recommended more-stories read-next popular trending", "div"),
    "share": ("share social sharing share-buttons follow", "div"),
    "crumbs": ("breadcrumb breadcrumbs crumbs path", "nav"),
    "paging": ("pagination pager page-links prev-next", "div"),
}
CONTENT = "content article post entry story main body article-body post-content entry-content text".split()
NEUTRAL = "container wrapper wrap row col inner page site layout grid box block section".split()
SYLLABLES = "the an er in on re st en ti es or th ed nd ou ea ha ing al is le ne ra mo ve so ka lu mi".split()


def lesson(seed: int) -> str:
    """A page whose parts carry data-label keep or drop."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return words(3, 18).capitalize() + r.choice([".", ".", ".", "!", "?", ", " + words(1, 6) + "."])

    def prose(a: int, b: int) -> str:
        out = " ".join(sentence() for _ in range(r.randint(a, b)))
        if r.random() < 0.25:
            out += f' <a href="/x">{words(1, 4)}</a> {sentence()}'
        return f"<b>{words(1, 3)}</b> {out}" if r.random() < 0.15 else out

    def element(tag: str, label: str, inner: str, names: list[str] | None = None) -> str:
        attr = f' class="{" ".join(names)}"' if names and r.random() < 0.8 else f' id="{names[0]}"' if names else ""
        return f'<{tag}{attr} data-label="{label}">{inner}</{tag}>'

    def link_list(a: int, b: int) -> str:
        if r.random() < 0.12:  # a line of links
            return r.choice([" | ", " ", " · ", " &gt; "]).join(f'<a href="/{word()}" data-label="drop">{words(1, 3)}</a>' for _ in range(r.randint(a, b)))
        items = "".join(f'<li data-label="drop"><a href="/{word()}" data-label="drop">{words(1, r.choice([1, 3, 8]))}</a></li>' for _ in range(r.randint(a, b)))
        return f'<ul data-label="drop">{items}</ul>'

    def part(kind: str) -> str:
        names, tag = PARTS[kind]
        chosen = [r.choice(names.split())]
        if r.random() < 0.3:
            chosen.append(r.choice(NEUTRAL))
        if tag in ("div", "section") or r.random() < 0.4:
            tag = r.choice(["div", "section", "div"])
        elif r.random() < 0.5:
            chosen = []
        drop = lambda t, inner: f'<{t} data-label="drop">{inner}</{t}>'
        if kind in ("menu", "crumbs", "paging"):
            inner = link_list(2, 9)
        elif kind == "header":
            inner = drop(r.choice(["h1", "div", "a", "p"]), words(1, 4)) + (link_list(2, 6) if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = "&copy; " + words(1, 20) + (link_list(1, 6) if r.random() < 0.5 else drop("p", sentence()) if r.random() < 0.5 else "")
        elif kind in ("sidebar", "related"):
            inner = drop(r.choice(["h2", "h3", "h4"]), words(1, 4)) + (link_list(2, 8) if r.random() < 0.7 else drop("p", prose(1, 3)))
        elif kind in ("advert", "notice", "share"):
            inner = r.choice([sentence(), words(2, 12), drop("p", prose(1, 3)), drop("a", words(1, 6)), sentence() + drop("a", words(1, 3))])
        elif kind == "form":
            tag = "form"
            inner = drop("label", words(1, 4)) + '<input type="text">' + drop("p", sentence())
        else:
            each = lambda: element("div", "drop", drop("span", words(1, 2)) + drop("p", prose(1, 5)), ["comment"] if r.random() < 0.6 else None)
            inner = drop("h3", words(1, 3)) + "".join(each() for _ in range(r.randint(1, 6)))
        return element(tag, "drop", inner, chosen or None)

    keep = lambda t, inner: f'<{t} data-label="keep">{inner}</{t}>'
    blocks = [keep("h1", words(1, 10))] if r.random() < 0.85 else []
    if blocks and r.random() < 0.15:
        blocks = [keep("header", blocks[0] + (keep("p", words(2, 6)) if r.random() < 0.4 else ""))]
    for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
        x = r.random()
        if x < 0.7:
            blocks.append(keep("p", prose(1, 8)) if r.random() < 0.9 else f'<p data-label="keep"><b data-label="keep">{prose(1, 6)}<br>')
        elif x < 0.78:
            blocks.append(keep(r.choice(["h2", "h3"]), words(1, 7)))
        elif x < 0.86:
            blocks.append(keep(r.choice(["ul", "ol"]), "".join(keep("li", prose(1, 2)) for _ in range(r.randint(2, 6)))))
        elif x < 0.9:
            blocks.append(keep("blockquote", keep("p", prose(1, 3))))
        elif x < 0.94:
            blocks.append(keep("table", "".join(keep("tr", keep("td", words(1, 4)) * 3) for _ in range(r.randint(1, 5)))))
        elif x < 0.97:
            blocks.append(keep("pre", words(4, 30)))
        else:
            blocks.append(keep("div", prose(1, 5)))
        if r.random() < 0.06:
            blocks.append(part(r.choice(["advert", "related", "share", "form"])))
    article = "".join(blocks)
    style = r.random()
    if style < 0.45:
        article = element("article", "keep", article, [r.choice(CONTENT)] if r.random() < 0.4 else None)
    elif style < 0.6:
        article = element("main", "keep", article, [r.choice(CONTENT)] if r.random() < 0.3 else None)
    elif style < 0.95:
        article = element(r.choice(["div", "section"]), "keep", article, [r.choice(CONTENT), *r.sample(NEUTRAL, r.randint(0, 1))])
    for _ in range(r.randint(0, 2)):
        article = element("div", "keep", article, [r.choice(NEUTRAL)]) if r.random() < 0.5 else article
    before = [part(k) for k in ("header", "menu", "crumbs", "notice", "advert") if r.random() < 0.45]
    after = [part(k) for k in ("share", "related", "comments", "sidebar", "paging", "form", "advert", "notice", "footer") if r.random() < 0.4]
    r.shuffle(after)
    if r.random() < 0.5:
        after.append(part("footer"))
    if r.random() < 0.2:
        before.append(after.pop() if after else "")
    body = "".join(before) + article + "".join(after)
    if r.random() < 0.3:
        body = element("div", "keep", body, [r.choice(NEUTRAL)])
    return f'<!DOCTYPE html><html data-label="keep"><head><title>{words(1, 8)}</title></head><body data-label="keep">{body}</body></html>'


@lru_cache(maxsize=1)
def trained(lessons: int = LESSONS) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and the log odds of attribute tokens, from labelled pages; inner elements inherit their label."""
    pages = [parse(lesson(s)) for s in range(lessons)]
    count: dict[str, list[float]] = {}
    labels = []
    for page in pages:
        own: list[int] = []
        for i, p in enumerate(page.parent):
            own.append(1 if p < 0 else own[p] if page.label[i] is None else int(page.label[i] == "keep"))
            for w in page.names[i]:
                count.setdefault(w, [1.0, 1.0])[own[i]] += 1
        labels.append(own)
    odds = {w: float(np.log(k / d)) for w, (d, k) in count.items()}
    x = np.concatenate([features(p, odds) for p in pages])
    return BoostedTrees().fit(x, np.concatenate([np.array(o, float) for o in labels])), odds


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html)."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                parsed = [parse(x or "") for x in part.column(2).to_pylist()]
                rows = [features(p, model[1]) for p in parsed]
                scores = np.split(model[0].scores(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [_text(p, decode(p, s)) for p, s in zip(parsed, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
