"""Tag-path ratios against a plain version over html.parser, and pages that once broke the extractor."""

import html
import math
import re
import time
import tracemalloc
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from corpuslake.llm import html_text

DATA = "/root/testdata/sf0.001"
TEXT = "A sentence of the text, with marks. "


class Plain(HTMLParser):
    """(path, text, share in links) of each block of a well-formed page."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.fresh, self.kept = [], [], True, set()

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.fresh = True
            if tag in html_text.CLOSES and 0 in html_text.CLOSES[tag] and "p" in self.stack:
                del self.stack[self.stack.index("p") :]
        if tag not in html_text.VOID:
            low = any(html_text.LOW_NAME.search(v or "") for k, v in attrs if k in ("class", "id")) and tag not in html_text.WHOLE
            self.stack.append(f"{tag}!" if low else tag)

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.fresh = True
        names = [t.rstrip("!") for t in self.stack]
        if tag in names:
            del self.stack[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        names = {t.rstrip("!") for t in self.stack}
        if names & html_text.NO_TEXT or "title" in names or ("header" in names and not names & {"article", "main"}):
            return
        path = tuple(t for t in self.stack if t.rstrip("!") in html_text.BLOCKS or t.endswith("!"))
        if self.fresh:
            self.blocks.append([path, "", 0])
            self.fresh = False
        self.blocks[-1][1] += data
        self.blocks[-1][2] += len(data) * ("a" in names) * (not data.isspace())


def plain_scores(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    blocks = [(p, t, a) for p, t, a in parser.blocks if t.strip()]
    by = defaultdict(list)
    for p, t, a in blocks:
        by[p].append((min(len(t.strip()), 511), min(len(re.findall(html_text._MARKS.pattern, t)), 15), a / len(t)))
    article = any({"article", "main"} & set(p) for p in by)
    rows = [(p, *(sum(x) / len(v) for x in zip(*v))) for p, v in by.items()]
    c, m = [math.log2(1 + r[1]) for r in rows], [math.log2(1 + r[2]) for r in rows]
    total = sum(len(t.strip()) for _, t, _ in blocks)
    share = lambda p: sum(len(t.strip()) for q, t, _ in blocks if q[: len(p)] == p) / total
    trust = 1 + (300 / total) ** 2
    near = lambda x, i: (x[max(i - 1, 0)] + 6 * x[i] + x[min(i + 1, len(x) - 1)]) / 8
    made = []
    for i, (p, _, _, link) in enumerate(rows):
        prior = (0.75 if any(t.endswith("!") for t in p) else 1) * (0.75 if article and not {"article", "main"} & set(p) else 1)
        own = sum(len(t.strip()) for q, t, _ in blocks if q == p) / total
        held = max([share(p), *(share(p[:k]) for k in range(1, len(p)) if share(p[:k]) < 0.98)])
        made.append(near(c, i) * (1 + near(m, i)) * (1 - link) * own**0.5 * held**2 * prior**trust)
    return made


def test_scores_against_plain_version(spark):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    pages += [f"<body><h1>T</h1><div class=ad><p>{TEXT}</p></div><div><p>{TEXT * n}</p><p>x <a>link</a></p><ul><li><a>Home</a></li><li>a, b</li></ul></div></body>" for n in range(1, 20)]
    for page in pages:
        got = list(html_text.scores(html_text.Page(page)).values())
        assert got == pytest.approx(plain_scores(page), rel=0.05)


def articles(page):
    """The text of a page's article, by regular expressions that fit the pages of the test tables."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1]
    parts = (html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", x)) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def right(pages, want, change=lambda p: p):
    return sum(html_text.main_text(change(p)) == t for p, t in zip(pages, want)) / len(pages)


def test_ratios_decide(spark, monkeypatch):
    """Without names, or without article elements, pages keep their match; without ratios, priors left in place, most change and few fit."""
    pages = [r.html for r in spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/pages.parquet").collect()]
    want = [articles(p) for p in pages]
    unnamed = lambda p: re.sub(r' class="[^"]*"', "", p)
    flat = lambda p: re.sub(r"(</?)article>", r"\1div>", p)
    assert right(pages, want) >= 0.995
    assert right(pages, want, unnamed) >= 0.98 and right(pages, want, flat) >= 0.98
    assert right(pages, want, lambda p: flat(unnamed(p))) >= 0.88
    usual = [html_text.main_text(p) for p in pages]

    def priors(page):
        seen = {}
        for el, _, size, _ in page.blocks:
            if size:
                seen.setdefault(el.path, el)
        inside = any(el.article for el in seen.values())
        return {p: (html_text.LOW if el.low else 1.0) * (html_text.OUTSIDE if inside and not el.article else 1.0) for p, el in seen.items()}

    monkeypatch.setattr(html_text, "scores", priors)
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, usual)) > 0.85 * len(pages)
    assert right(pages, want) < 0.15


@pytest.mark.parametrize("name", ["zq-7", "links-of-some-kind", "c1 c2", ""])
def test_menus_of_unknown_names_go(name):
    menu = f'<div class="{name}"><ul><li><a href="/">Home</a></li><li><a href="/s">Shop, and more</a></li></ul><div><a href="/b">Buy cheap shoes now</a></div></div>'
    body = f"<h1>Title</h1><p>{TEXT * 5}</p><ul><li>a point</li></ul><p>Short.</p>"
    want = f"Title\n{(TEXT * 5).strip()}\na point\nShort."
    for around in ("article", "div", "section"):
        assert html_text.main_text(f"<body>{menu}<{around}>{body}</{around}>{menu}</body>") == want
    assert html_text.main_text(f"<body><article>{body}{menu}</article></body>") == want
    assert html_text.main_text(f"<body>{menu}<div><div>{body}</div>{menu}</div></body>") == want


@pytest.mark.parametrize("name", ["notice", "promo-box", "social", "hidden", "widget"])
def test_names_alone_leave_no_article_out(name):
    assert html_text.main_text(f'<body><nav>Menu</nav><div class="{name}"><p>{TEXT * 5}</p><p>Short.</p></div></body>') == (TEXT * 5).strip() + "\nShort."


@pytest.mark.parametrize("page", ["<a x" * 250_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<p><div>" + "<span>" * 50_000 + "<hr>" * 50_000, "<p>t <a b='x>" * 60_000, "<div>" * 50_000 + "</x>" * 50_000, "<ul><li>" * 50_000])
def test_broken_pages_take_time_and_memory_by_their_length(page):
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 10
    tracemalloc.start()
    html_text.main_text(page)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_a_megabyte_of_text_is_kept_whole():
    text = (TEXT * 30_000).strip()
    assert html_text.main_text(f"<article><h2>T</h2><p>{text}</p></article>") == "T\n" + text


def test_what_follows_an_article_is_judged_by_its_ratios():
    """In a nameless element of the article, as of readers' comments."""
    for tail in ("<div>Anna wrote: I do not agree</div>", "<div><p>Anna wrote:</p><p>No.</p></div>"):
        assert html_text.main_text(f"<body><article><h1>T</h1><p>{TEXT * 5}</p><p>{TEXT * 9}</p>{tail}</article></body>") == f"T\n{(TEXT * 5).strip()}\n{(TEXT * 9).strip()}"
    for tag in ("blockquote", "pre", "ul"):
        assert html_text.main_text(f"<body><article><p>{TEXT * 9}</p><{tag}>A few words</{tag}></article></body>").endswith("\nA few words")
