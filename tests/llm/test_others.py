import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from twins import DATA, connection, same

from corpuslake.llm import ann, html_text, langid, licenses, mixing, notices, queries, urls


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA).toPandas(), connection().sql(queries.ORACLE_SQL[name]).df())


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()
    assert got.filter("rejected").count() == 0


def test_languages_of_few_distinct_texts_are_learned(spark):
    texts = {f"l{i}": f"{chr(97 + i) * 3} {chr(98 + i)}{chr(99 + i)} word of its own {chr(97 + i)}" for i in range(12)}
    labelled = spark.createDataFrame([(t, lang) for lang, t in texts.items() for _ in range(1000)], "text string, lang string")
    assert set(langid.fit(labelled).languages) == set(texts)


def test_language_rejects_what_is_far_from_all(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    strange = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок да выпей чаю. " * 20), (2, "12 34"), (3, None)], "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(strange, model).collect())


def test_gram_counts_do_not_depend_on_blocks(monkeypatch):
    texts = ["Größe, 12 und mehr Wörter ... " * 40, "", "a", " ", "ab", " a b ", "x" * 300, "  " * 200 + "y", "z" + " " * 300]
    whole = [langid.gram_counts(t) for t in texts]
    for block in (1, 2, 3, 7, 97):
        monkeypatch.setattr(langid, "BLOCK", block)
        for t, (counts, letters) in zip(texts, whole):
            parts = langid.gram_counts(t)
            assert parts[1] == letters and (parts[0] == counts).all()


def test_language_of_odd_rows(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows}[3] == "und"
    assert langid.identify(empty).count() == 0
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 6}
    assert langid.accepted(empty).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def brute(ids, x, q, k):
    s = (x * x[q]).sum(1)
    s[ids == ids[q]] = -np.inf
    return [ids[i] for i in np.lexsort((ids, -s))[:k] if np.isfinite(s[i])]


def test_neighbour_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = table.orderBy("vec_id").toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    got = ann.search(table, F.col("vec_id") % 20 == 0).toPandas()
    hits = sum(len(set(brute(ids, x, q, 20)) & set(got[got.query_id == ids[q]].vec_id)) for q in np.flatnonzero(ids % 20 == 0))
    assert got.groupby("query_id").size().eq(20).all()
    assert hits / len(got) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    one = [1.0, 0.0]
    rows = [(0, one), (0, one), (1, one), (2, one), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [0.5, 0.5]), (None, one), (20, [0.0, 1.0]), (9, [float("inf"), 1.0])]
    got = ann.search(vectors(spark, [(*r, 1, "x") for r in rows]), F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 1.0), (0, 2, 1.0), (0, 8, 0.5), (20, 8, 0.5), (20, 0, 0.0), (20, 1, 0.0)]
    assert ann.search(vectors(spark, []), F.lit(True)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0], 1, "x") for i in range(3000)]
    got = ann.search(vectors(spark, rows), F.col("vec_id") == 2000).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([[x, y] for x in range(16) for y in range(16)])
    order = grid[np.argsort(ann.hilbert_keys(grid, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0  # full
    assert got["b"] == pytest.approx((1.5 * 2010 - 20) / 3) and got["c"] == pytest.approx(2 * got["b"])


def test_mixing(spark, odd, empty):
    plan = mixing.taken(odd).collect()
    assert len(plan) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in plan)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target)
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns
    counted = mix.select(F.sum(mixing.size_of(F.col("text"))).alias("n")).first().n
    assert counted == sum(r.taken for r in plan)
    assert sorted(map(str, mix.collect())) == sorted(map(str, mixing.mixed(odd).collect()))
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_better_documents_come_first(spark):
    rows = [(i, ("good words here " if i % 2 else "1 2 3 4 ") * 20, "a") for i in range(400)] + [(1000 + i, "x " * 2000, "b") for i in range(2)]
    plan = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 30), share=1.0, most=2.0).filter("source = 'a'").toPandas()
    plan = plan.assign(good=plan.doc_id % 2 == 1, part=plan.taken / plan["size"])
    assert plan[plan.good].part.mean() > plan[~plan.good].part.mean() + 0.1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><a>Home</a></header><div id="cookie-notice">We use cookies.</div>
<nav><ul><li>Menu</li></ul></nav><aside>Side</aside><article><h1>Head &amp; line</h1><p>First&nbsp;paragraph,
of   some length; with marks.<p>Second one. <b>Bold</b> text<br>here.</p><ul><li>point</li></ul><form><label>Name</label></form>
<section class="comments"><p>Great post, thanks. I liked it, really.</p></section></article><script>var a = "<p>no</p>";</script><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph, of some length; with marks.\nSecond one. Bold text here.\npoint"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<br>") == ""
    assert html_text.main_text("plain text &lt; tags") == "plain text < tags"
    assert html_text.main_text("<div class='content'><p>One sentence, long enough to be read.</p><p>Two.</p></div><div class='footer'>Foot</div>") == "One sentence, long enough to be read.\nTwo."
    assert html_text.main_text("<body><article><p>cut off in the mid") == "cut off in the mid"


def test_pages_without_article_keep_all_sections():
    long, short = "A sentence of the text, with marks. " * 8, "Another one, shorter; still text. " * 5
    assert html_text.main_text(f"<body><h1>Title</h1><div class=text><p>{long}</p></div></body>") == "Title\n" + long.strip()
    assert html_text.main_text(f"<body><div id=content><section><p>{long}</p></section><section><p>{short}</p></section></div></body>") == long.strip() + "\n" + short.strip()
    for tag in ("blockquote", "div"):
        assert html_text.main_text(f"<body><div><p>{short}</p><{tag}><p>{long}</p></{tag}></div><nav>Home</nav></body>") == short.strip() + "\n" + long.strip()
    assert html_text.main_text(f"<body><table><tr><td><p>{long}</p></td><td><p>{short}</p></td></tr></table></body>") == long.strip() + "\n" + short.strip()


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-comments", "post comments-open", "related-to-x", "search-engines", "sidebar"])
def test_wrappers_that_only_mention_a_part_stay(name):
    text = "A sentence of the text, with marks. " * 7
    for key in ("class", "id"):
        assert html_text.main_text(f'<body><div {key}="{name}"><h1>Title</h1><p>{text}</p></div><div class="footer">Foot</div></body>') == "Title\n" + text.strip()
        if name != "sidebar":
            assert html_text.main_text(f'<body><div><p>{text}</p></div><div {key}="{name}"><p>Short, but text.</p></div></body>') == text.strip() + "\nShort, but text."


@pytest.mark.parametrize("name", ["sidebar", "left-sidebar", "post-comments", "cookie-notice", "nav-links", "x menu-item", "site_footer", "social-share-buttons", "hidden y"])
def test_parts_named_as_no_article_text_go(name):
    text = "A sentence of the text, with marks. " * 7
    assert html_text.main_text(f'<body><div><p>{text}</p></div><div class="{name}"><p>Short, but text.</p></div></body>') == text.strip()


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert [r.n_chars for r in rows] == [len(html_text.main_text(PAGE))] * 2 + [0]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_articles_are_the_documents(spark):
    pages, docs = spark.read.parquet(f"{DATA}/pages.parquet"), spark.read.parquet(f"{DATA}/documents.parquet")
    shown = pages.withColumn("doc_id", F.regexp_extract("url", r"/([0-9]+)", 1).cast("long"))
    for r in html_text.extract(pages).join(shown.select("page_id", "doc_id"), "page_id").join(docs.select("doc_id", F.col("text").alias("want")), "doc_id").collect():
        want = "\n".join(x for x in (" ".join(line.split()) for line in r.want.split("\n")) if x)
        assert r.text.split("\n", 1)[1:] == ([want] if want else [])  # under its title


def test_urls(spark):
    rows = [("http://EXAMPLE.net/en/1", "allow", "example.net/en/"), ("https://a.net", "allow", None), ("https://a.net/x", "block", "net/"), ("ftp://www.example.com/de/?q", "block", "example.com/de/"), ("x://notexample.com/de/", "allow", None), ("http://é.org/fr/", "allow", "org/fr/"), ("no url", "allow", None), (None, "allow", None), ("http://h/a://b/c?d", "allow", None)]
    pages = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert [(got[i].verdict, got[i].rule) for i in range(len(rows))] == [(v, r) for _, v, r in rows]
    assert (got[0].host, got[0].path, got[8].host, got[8].path, got[6].host, got[7].path) == ("example.net", "/en/1", "h", "/a://b/c", "", "")
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_reputation_shrinks(spark):
    rows = [(f"h{i}.bad.org", 1) for i in range(30) for _ in range(6)] + [(f"h{i}.good.org", 0) for i in range(30) for _ in range(6)] + [("new.bad.org", 0)] + [("one.mixed.org", 1)]
    got = {(r.level, r.name): r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["host", "h1.bad.org"].lower > 0.5 > got["host", "h1.good.org"].rate
    assert got["host", "new.bad.org"].rate > got["host", "h1.good.org"].rate  # its domain's record counts
    assert got["host", "one.mixed.org"].lower < 0.5  # one page blocks nothing


def test_licenses(spark, odd, empty):
    mit = next(t for t, label in licenses.TEMPLATES.items() if label == "mit")
    rows = [(1, f"x y {mit} z"), (2, mit.replace("free of charge", "wholly free of any charge")), (3, "The MIT-License, mit license; General Public License general public\nlicense"), (4, "general public; license public"), (5, mit[:60]), (6, "apache  LICENSE")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score, got[1].n_base) == ("mit", 1.0, 0)
    assert got[2].labels == "mit" and 0.8 <= got[2].score < 1
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (4, 1, 8, "gpl,mit")
    assert (got[4].n_base, got[4].first_word, got[4].labels) == (1, 0, "gpl")
    assert (got[5].labels, got[5].score) == ("", 0.0)
    assert got[6].base_labels == "apache"
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(empty).count() == 0
    assert isinstance(licenses.scan(empty).toPandas(), pd.DataFrame)


def plain_spans(text, templates, cover=0.8):
    """(label, first word, last word, share) of the passages of a text, gram by gram."""
    said = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out, seen = [], {}
    for passage, label in templates.items():
        for g in zip(*(licenses._words(passage)[j:] for j in range(4))):
            seen.setdefault(g, set()).add(label)
    for i, (passage, label) in enumerate([*licenses.PHRASES.items(), *templates.items()]):
        base, words = i < len(licenses.PHRASES), licenses._words(passage)
        k, lines = 2 if base else 4, {}
        for p in range(len(said) - k + 1):
            for t in range(len(words) - k + 1):
                if said[p : p + k] == words[t : t + k]:
                    lines.setdefault(p - t, []).append(t)
        groups = []
        for d in sorted(lines):
            if base or not groups or d - groups[-1][-1] > licenses.GAP:
                groups.append([])
            groups[-1].append(d)
        for g in groups:
            share = len({t + j for d in g for t in lines[d] for j in range(k)}) / len(words)
            shared = all(len(seen[x]) > 1 for x in zip(*(words[j:] for j in range(4)))) if not base else True
            own = shared or any(len(seen[tuple(words[t : t + 4])]) == 1 for d in g for t in lines[d])
            if share == 1 if base else own and share >= cover:
                out.append((label, min(d + min(lines[d]) for d in g), max(d + max(lines[d]) + k - 1 for d in g), round(share, 9)))
    return sorted(out)


def test_license_spans_against_plain_search(spark, odd):
    """Whole notices, with words changed, left out and put in, twice in a text, and only begun."""
    mit, bsd, zlib = notices.MIT, notices.BSD_2, notices.ZLIB
    edited = mit.replace("without limitation", "with no limitation").replace("OR OTHERWISE, ", "").replace("copies of the Software", "any copies of the Software")
    cut = " ".join(bsd.split()[: len(bsd.split()) * 7 // 10])
    rows = [(1, f"some words {mit} and {bsd}"), (2, edited), (3, f"{zlib} MIT License {zlib.upper()}"), (4, cut), (5, notices.GPL), (6, notices.LGPL), (7, "the software is provided"), (8, None)]
    rows += [(9 + i, f"{text} tail") for i, text in enumerate(notices.NOTICES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in licenses.spans(docs).collect():
        got.setdefault(r.doc_id, []).append((r.label, r.first_word, r.last_word, round(r.share, 9)))
    for doc_id, text in rows:
        assert sorted(got.get(doc_id, [])) == plain_spans(text, licenses.TEMPLATES), doc_id
    whole = len(licenses._words(mit))
    assert ("mit", 2, whole + 1, 1.0) in got[1]
    assert any(label == "mit" and last - first > 150 and 0.8 <= share < 1 for label, first, last, share in got[2])
    assert len([x for x in got[3] if x[0] == "zlib"]) == 2
    assert {x[0] for x in got[4]} == {"bsd"} and all(x[2] < 40 for x in got[4])  # the opening alone
    labels = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert labels[6] == ("gpl,lgpl", 1.0) and labels[5] == ("gpl", 1.0) and labels[7] == ("", 0.0)
    for (doc_id, _), label in zip(rows[8:], notices.NOTICES.values()):
        assert label in labels[doc_id][0].split(",") and labels[doc_id][1] == 1.0
    told = {}
    for r in licenses.spans(docs).filter(F.col("template") >= len(licenses.PHRASES)).collect():  # the words of a phrase are in other licenses too
        told.setdefault(r.doc_id, set()).add(r.label)
    assert [told[doc_id] for doc_id, _ in rows[8:]] == [{label} for label in notices.NOTICES.values()]
    assert (told[5], told[6]) == ({"gpl"}, {"lgpl"})
    assert licenses.spans(odd).count() == 0


def test_hot_names_are_looked_up_alike(spark, monkeypatch):
    """Most hosts in one suffix and one domain, with and without broadcast look-ups."""
    rows = [(i, f"http://h{i % 50}.big.com/{i}" if i % 5 else f"http://s{i}.example.{'org' if i % 2 else 'xyz'}/") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(0, 300, 2)], "page_id long, bad int")
    got = {}
    for share in (1, 1000, 3):
        monkeypatch.setattr(urls, "HOT_NAMES", share)
        got[share] = sorted(map(tuple, urls.judge(pages, labels).collect()))
    assert got[1] == got[1000] == got[3]
    assert len(got[1]) == 300


def plain_buckets(text):
    """The bucket of every 1- to 3-gram of the text's letters, with anything else as one space."""
    x, full = [32], (1 << 32) - 1
    for c in map(ord, (text or "").lower() + " "):
        c = c if chr(c).isalpha() else 32
        if c != 32 or x[-1] != 32:
            x.append(c)
    x = x if x[-1] == 32 else [*x, 32]
    for i in range(len(x)):
        g = x[i] * 0x9E3779B1 & full
        for n in (1, 2, 3):
            if n > 1 and i + n <= len(x):
                g = (g * (3 + n if n == 2 else 7) + x[i + n - 1] * (0x85EBCA77, 0xC2B2AE3D)[n - 2] + n - 1) & full
            if i + n <= len(x):
                yield (((g ^ g >> 15) * 0x2C1B3C6D) & full) >> 20


def test_predictions_against_dense_vectors(spark):
    """The nearest centroid of every text by grams counted one by one, with all centroids."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 60")
    model = langid.fit(docs)
    for r in langid.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        dense = np.zeros(len(model.idf))
        for bucket in plain_buckets(r.text):
            dense[bucket] += 1
        dense = np.log1p(dense) * model.idf
        dense /= np.linalg.norm(dense) or 1
        likeness = [float((dense * c).sum()) for c in model.centroids]
        best = int(np.argmax(likeness))
        assert r.lang_pred == (model.languages[best] if any(c.isalpha() for c in r.text or "") else langid.NONE)
        assert r.score == pytest.approx(max(0.0, min(1.0, likeness[best])), abs=1e-4)
