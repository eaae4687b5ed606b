"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each at the end of a tag path (the block-level elements from the root to it; inline ones, as b or
span, are no steps). For every path, text length, punctuation, the share of text in links, and the shares of the page's text that the path and its
largest container have are aggregated over its blocks; length and punctuation are smoothed along the page's paths, all are fused, and the paths above the threshold are
selected. Between selected blocks of a container the others stay too, but for lists of links; after the last one lists, tables and quotations do, and what has ratios not far
below; headings just before the first one belong to it.

The kinds of element that the result leaves out (menus, headers and footers of the site, sidebars, forms, scripts) are no candidates. Names in class
and id, and a place outside article and main, lower a path's score by a quarter: they decide where ratios are near each other, and on very short pages.

Defined results: a null or empty html, or one without text, gives an empty string; cut pages are read as far as they go; repeated
rows are alike; a null page_id or url is kept; an empty table gives no rows; extra columns are ignored. No text is dropped
or capped for its length, and time and memory grow with a page's length, whatever its nesting and however it is broken.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import log2, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: For each start tag, the groups of open elements that it closes, outermost first.
GROUPS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "option": 3, "td": 4, "th": 4, "tr": 5, "tbody": 6, "thead": 6, "tfoot": 6}
CLOSES = {"li": (1,), "dt": (2,), "dd": (2,), "option": (3,), "td": (4,), "th": (4,), "tr": (5, 4), "tbody": (6, 5, 4), "thead": (6, 5, 4), "tfoot": (6, 5, 4)}
CLOSES |= {tag: (0,) for tag in BLOCKS - {"html", "body", "caption", "legend", *CLOSES}}
#: Elements that hide the open elements of a group above them from later start tags.
HIDES = {"ul": (0, 1), "ol": (0, 1), "menu": (0, 1), "dl": (0, 2), "select": (3,), "table": (0, 4, 5, 6), "tr": (4,)}
HIDES |= dict.fromkeys("html body main article section div blockquote center li dd td th".split(), (0,))
#: Elements that are never part of an article, by tag and role.
NO_TEXT = frozenset(
    "head script style noscript template svg canvas object iframe noframes select option datalist button input textarea nav footer aside form dialog menu label fieldset".split()
)
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Whole names in class or id that lower a score: "sidebar", "left-sidebar" and "sidebar-menu", but not "has-sidebar".
LOW_NAME = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|header|footer|mobile|desktop|inline|post|entry|article|blog|user|author|wp|js|google"
    r"|email|cookie|social|nav)[-_])*(?:ads?|adverts?|advertis\w*|adbox|adsense|sponsor\w*|promo\w*|banners?|side-?bar\w*|menus?|nav|navs|navbar\w*|navigation|breadcrumbs?"
    r"|footers?|site-?header|page-?header|top-?bar|masthead|cookies?\w*|consent|gdpr|notices?|notification\w*|alerts?|popups?|pop-up|modals?|overlay|newsletters?"
    r"|subscri\w*|paywall|shar(?:e|es|ing)|social\w*|related|recommend\w*|read-?more|comments?|commentlist|disqus\w*|repl(?:y|ies)|respond"
    r"|pagination|pager|widgets?|toolbar|skip-?link|login|log-in|signup|sign-up|search\w*|tag-?cloud|toc-?nav|hidden|sr-only|visually-hidden)"
    r"(?:[-_](?:ads?|bars?|box|banner|notice|consent|popup|modal|overlay|message|container|wrapper|wrap|inner|outer|area|section|block|body|content|header|footer|title"
    r"|heading|list|links?|items?|menu|nav|navigation|toggle|widgets?|form|button|btn|buttons|icons?|media|posts?|articles?|stories|reading|signup|text|left|right|top"
    r"|bottom|main|primary|secondary|[0-9]+))*(?=$|\s)",
    re.I,
)
WHOLE = frozenset("html body main article".split())
#: A block's length and marks count up to these in a path's ratio: beyond them text is long enough to be content.
FULL_LENGTH, FULL_MARKS = 511, 15
#: Shares of the page's mean score that select a path, and that keep a block beside selected ones.
THRESHOLD, BESIDE = 0.5, 0.3
#: Factors of paths in elements with a LOW_NAME, and outside article and main where there is one. Ratios outweigh them, but on pages of few characters,
#: where ratios say little: SHORT characters square the factors.
LOW, OUTSIDE, SHORT = 0.75, 0.75, 300
#: Elements that belong to the text that they follow.
PARTS = frozenset("ul ol dl table blockquote pre figure".split())
#: A container with this share of a page's text is about all of it.
ALL = 0.98
#: A block with this share of its text in links isn't rescued.
LINKS = 0.5

_MARKS = re.compile(r"[.,;:!?¿¡…。，、；：！？\"“”«»()]")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


class Element:
    """An open element: its block-level one, the number of its path, and what its ancestors make of it."""

    __slots__ = ("tag", "up", "number", "block", "path", "out", "low", "article", "link", "open")

    def __init__(self, tag: str, up: Element | None, number: int):
        self.tag, self.up, self.number = tag, up, number
        self.block = self if up is None or tag in BLOCKS else up.block
        self.path, self.out, self.low, self.article, self.link = (up.path, up.out, up.low, up.article, up.link) if up else (0, False, 0, False, False)
        self.open = up.open if up else (None,) * 7


class Page:
    """The blocks of a page: elements in order of their start tags, and for each block [element, texts, length, length in links]."""

    def __init__(self, html: str):
        root = Element("", None, 0)
        self.elements, self.blocks, self.paths = [root], [], {}
        self._top, self._fresh, self._opened = root, True, {}
        self._read(html)

    def _text(self, piece: str) -> None:
        if not piece or self._top.out:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        size = len(piece) if not piece.isspace() else 0
        if self._fresh:
            self.blocks.append([self._top.block, [], 0, 0])
            self._fresh = False
        block = self.blocks[-1]
        block[1].append(piece)
        block[2] += size
        block[3] += size * self._top.link

    def _start(self, tag: str, attributes: str) -> None:
        top = self._top
        for group in CLOSES.get(tag, ()):
            if top.open[group] is not None:
                self._close(top.open[group])
                top = self._top
                break
        if tag == "br":
            self._text(" ")
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            return
        el = Element(tag, top, len(self.elements))
        self.elements.append(el)
        el.article = top.article or tag in ("article", "main")
        el.link = top.link or tag == "a"
        el.out = top.out or tag in NO_TEXT or tag == "header" and not el.article
        low = False
        if attributes and not el.out:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name == "role":
                    el.out |= value.lower() in NO_ROLE
                elif name == "hidden" or name == "aria-hidden":
                    el.out |= value.lower() != "false" and (name == "hidden" or value.lower() == "true")
                elif tag not in WHOLE and LOW_NAME.search(value):
                    low = True
        el.low += low
        if el.block is el or low:
            el.path = self.paths.setdefault((top.path, tag, low), len(self.paths) + 1)
        if tag in HIDES or tag in GROUPS:
            seen = list(top.open)
            for group in HIDES.get(tag, ()):
                seen[group] = None
            if tag in GROUPS:
                seen[GROUPS[tag]] = el
            el.open = tuple(seen)
        self._opened[tag] = self._opened.get(tag, 0) + 1
        self._top = el

    def _close(self, el: Element) -> None:
        while True:
            top = self._top
            self._opened[top.tag] -= 1
            self._top = top.up
            if top is el:
                return

    def _end(self, tag: str) -> None:
        if self._opened.get(tag):
            while self._top.tag != tag:
                self._close(self._top)
            self._close(self._top)

    def _read(self, page: str) -> None:
        at, find = 0, page.find
        while True:
            lt = find("<", at)
            if lt < 0:
                self._text(page[at:])
                return
            sign = page[lt + 1 : lt + 2]
            if not (sign.isascii() and (sign.isalpha() or sign in ("/", "!", "?"))) or not sign:
                if not sign and lt + 1 == len(page):
                    self._text(page[at:lt])
                    return
                self._text(page[at : lt + 1])
                at = lt + 1
                continue
            self._text(page[at:lt])
            if sign == "!" and page.startswith("<!--", lt):
                end = find("-->", lt + 2)
                at = end + 3
            elif sign in "!?":
                end = find(">", lt)
                at = end + 1
            else:
                name = _NAME.match(page, lt + 1 + (sign == "/"))
                start = name.end() if name else lt + 2
                end = _tag_end(page, start)
                at = end + 1
                if end >= 0 and name:
                    tag = name[0].lower()
                    if tag in BLOCKS:
                        self._fresh = True
                    if sign == "/":
                        self._end(tag)
                    else:
                        self._start(tag, page[start:end])
                        if tag in RAW:
                            at = self._raw(page, tag, at)
            if end < 0:  # a tag or comment that never ends
                return

    def _raw(self, page: str, tag: str, at: int) -> int:
        """Past the element's end tag: what it holds is no markup, and no text of the page."""
        self._end(tag)
        end = _ENDS[tag].search(page, at)
        return end.end() if end else len(page)


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag; those in quoted values don't. -1 where there is none."""
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            return -1
        at = stop.start()
        if page[at] == ">":
            return at
        before = at - 1
        while page[before].isspace():
            before -= 1
        close = page.find(page[at], at + 1) if page[before] == "=" else at
        at = (close if close >= 0 else at) + 1


def _smooth(x: list[float]) -> list[float]:
    """Each path lends an eighth of its ratio to those beside it."""
    padded = [x[0], *x, x[-1]]
    return [(a + 6 * b + c) / 8 for a, b, c in zip(padded, x, padded[2:])]


def _shares(page: Page, whole: dict[int, int]) -> dict[int, float]:
    """Of each path with text the share of the page's text that its largest container has: the path itself, or one that it begins with and
    that isn't about all of the page."""
    total, up, under = sum(whole.values()), {n: key[0] for key, n in page.paths.items()}, {}
    for p, n in whole.items():
        while p:
            under[p] = under.get(p, 0) + n
            p = up[p]
    found = {}
    for p in whole:
        most, at = under.get(p, total), up.get(p, 0)
        while at:
            if under[at] < ALL * total:
                most = max(most, under[at])
            at = up[at]
        found[p] = most / max(total, 1)
    return found


def scores(page: Page) -> dict[int, float]:
    """The fused, smoothed ratio of each path that has text, in page order."""
    count, length, marks, links, whole, seen = {}, {}, {}, {}, {}, {}
    for el, texts, size, linked in page.blocks:
        if size:
            p = el.path
            text = "".join(texts).strip()
            seen.setdefault(p, el)
            count[p] = count.get(p, 0) + 1
            whole[p] = whole.get(p, 0) + len(text)
            length[p] = length.get(p, 0) + min(len(text), FULL_LENGTH)
            marks[p] = marks.get(p, 0) + min(len(_MARKS.findall(text)), FULL_MARKS)
            links[p] = links.get(p, 0) + min(1.0, linked / size)
    if not count:
        return {}
    chars = _smooth([log2(1 + length[p] / n) for p, n in count.items()])
    points = _smooth([log2(1 + marks[p] / n) for p, n in count.items()])
    shares, total = _shares(page, whole), max(sum(whole.values()), 1)
    articles = any(el.article for el in seen.values())
    trust = 1 + (SHORT / total) ** 2
    found = {}
    for p, c, m in zip(count, chars, points):
        prior = (LOW if seen[p].low else 1.0) * (OUTSIDE if articles and not seen[p].article else 1.0)
        found[p] = c * (1 + m) * (1 - links[p] / count[p]) * sqrt(whole[p] / total) * shares[p] ** 2 * prior**trust
    return found


def _selected(page: Page) -> tuple[list[bool], list[bool]]:
    """Whether each block is on a path above the threshold, a share of the mean score of the page's text; and whether it is on one above the lower one."""
    found = scores(page)
    total = sum(size for _, _, size, _ in page.blocks)
    mean = sum(found[el.path] * size for el, _, size, _ in page.blocks if size) / max(total, 1)
    above = lambda share: [bool(size) and found[el.path] > 0 and found[el.path] >= share * mean for el, _, size, _ in page.blocks]
    return above(THRESHOLD), above(BESIDE)


def _container(page: Page, chosen: list[bool]) -> tuple[Element, list[int]]:
    """The element that the selected blocks share, and for each element the number of the last one in it.

    An article or main element about it is taken whole; else the next containers are, as long as they have no other
    text than plain blocks."""
    inside, odd, last = ([0] * len(page.elements) for _ in range(3))
    for (el, _, size, linked), yes in zip(page.blocks, chosen):
        inside[el.number] += yes
        odd[el.number] += bool(size) and not yes and (linked >= LINKS * size or el.low > 0)
    total = sum(inside)
    for i in range(len(page.elements) - 1, -1, -1):
        el = page.elements[i]
        last[i] = max(last[i], i)
        odd[i] += el.out and not (el.up and el.up.out) and el.tag in BLOCKS
        if el.up is not None:
            up = el.up.number
            inside[up] += inside[i]
            odd[up] += odd[i]
            last[up] = max(last[up], last[i])
    held = next(el for (el, *_), yes in zip(page.blocks, chosen) if yes)
    held = held.up.block if held.up else held
    while inside[held.number] < total:
        held = held.up.block
    if held.article:
        while held.tag not in ("article", "main"):
            held = held.up
    else:
        while held.up is not None and held.up.block.tag not in ("", "html", "body") and odd[held.up.block.number] == odd[held.number]:
            held = held.up.block
    return held, last


def _within(el: Element, held: Element) -> bool:
    """Whether a list, table, quotation or figure of the container holds the element."""
    while el is not held and el is not None:
        if el.tag in PARTS:
            return True
        el = el.up
    return False


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    chosen, near = _selected(page)
    if not any(chosen):
        return ""
    held, last = _container(page, chosen)
    first, end = chosen.index(True), len(chosen) - chosen[::-1].index(True)
    picked = list(chosen)
    beside = lambda i, el: el.low <= held.low and held.number <= el.number <= last[held.number] and (near[i] or _within(el, held))
    title = on = True  # the headings just before the first selected block, and what has ratios not far below its own
    for i in range(first - 1, -1, -1):
        el, _, size, linked = page.blocks[i]
        if size:
            on = on and linked < LINKS * size and beside(i, el)
            picked[i] = on or el.low <= held.low and el.tag in HEADINGS and (title or el.tag == "h1")
            title &= picked[i]
    for i in range(first + 1, len(chosen)):
        el, _, size, linked = page.blocks[i]
        if size and not chosen[i] and held.number <= el.number <= last[held.number]:
            # Between selected blocks, or on from the last of them: lists, tables and quotations, and others whose ratios are not far below.
            heading = el.tag in HEADINGS and i < end
            plain = el.low <= held.low and (heading or linked < LINKS * size)
            picked[i] = plain and (i < end or picked[i - 1] and beside(i, el))
        elif not size:
            picked[i] = picked[i - 1]
    lines = (" ".join("".join(texts).split()) for (_, texts, _, _), yes in zip(page.blocks, picked) if yes)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
