"""Quotes located in texts that spell a word both ways."""

import duckdb
import pytest
from twins import DATA, rows

from corpuslake import plans
from corpuslake.operators import phrases


@pytest.mark.parametrize("name", ["t4_locate", "a16_locate_status"])
def test_sharp_s_and_double_s_are_two_words(spark, tmp_path, name):
    texts = ["sslich a b c d e f g h i j k ßlich", "ﬁn a b c d e f g h i j k fin", "x² a b c d e f g h i j k X2"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'de', 'a', 1)", [(2 * i, t) for i, t in enumerate(texts)])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got, want = plans.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(plans.ORACLE_SQL[name]).df()
    assert set(want["status"]) == {"matched"}
    assert rows(got) == rows(want)


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["t4_locate", "a16_locate_status"])
def test_quotes_words_and_pages_are_dealt_out_once(spark, name):
    """By document: quotes, words and pages (these by page before, to be distinct); then lines' boxes, and lists or counts of them."""
    assert shuffles(plans.QUERIES[name](spark, DATA)) <= 6


def test_words_without_tokens_are_in_no_box(spark):
    """A dash between two words stands lower than they do, and a word parted by a page's end is on both pages."""
    text = [("one", 1, 0.0), ("—", 1, 50.0), ("two-", 1, 0.0), ("fold", 2, 0.0), ("three", 2, 0.0)]
    words = spark.createDataFrame([(1, p, 0, 0, i, w, 10.0 * i, y, 10.0 * i + 5, y + 10) for i, (w, p, y) in enumerate(text)], "doc_id int, page int, block int, line int, n int, raw string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, p, 100.0, 100.0) for p in (1, 2)], "doc_id int, page int, width double, height double")
    quotes = spark.createDataFrame([(1, 1, 1, ["one", "twofold"]), (2, 1, 1, []), (3, 2, 1, ["one"])], "quote_id int, doc_id int, start_page int, tokens array<string>")
    got = {r.quote_id: r for r in phrases.locate(quotes, words, pages).collect()}
    assert {k: (r.status, r.page) for k, r in got.items()} == {1: ("matched", 1), 2: ("not_found", None), 3: ("not_found", None)}
    assert [(b.page, b.x, b.y, b.width, b.height) for b in got[1].rectangles] == [(1, 0.0, 0.0, 0.25, 0.1), (2, 0.3, 0.0, 0.05, 0.1)]
