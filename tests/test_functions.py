import datetime

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import keys, policy, udfs, values
from corpuslake.operators import evals, lookup, memory, phrases, registry, segment


def column(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_identifiers(spark):
    assert column(spark, ["Act 559", "AKTA 265", "act no. 56", " a1791 ", None, "559"], keys.canonical_act) == ["559", "265", "56", "A1791", "", "559"]
    assert column(spark, ["Section 90A(1)", "seksyen 60d", "s. 4", "12", "none", None], keys.canonical_section) == ["90A", "60D", "4", "12", "", ""]
    assert column(spark, ["what says section 90A?", "seksyen 34 Penal Code", "nothing"], keys.extract_section) == ["90A", "34", None]
    assert column(spark, ["the Penal Code", "Act 709 applies", "hello"], keys.act_hint) == ["574", "709", None]


def test_document_id_needs_safe_parts(spark):
    sha = "a" * 64
    rows = spark.createDataFrame([("P.U. (A) 12", "EN", sha), ("", "en", sha), ("1", "e n", sha), ("1", "en", "x")], "a string, l string, s string")
    got = [r[0] for r in rows.select(keys.document_id(F.col("a"), F.col("l"), F.col("s"))).collect()]
    assert got == [f"act-p-u-a-12-en-sha256-{sha}", None, None, None]


def test_dates(spark):
    day = datetime.date(2020, 2, 1)
    assert column(spark, ["01/02/2020", "1/2/2020", "31/02/2020", "2020-02-01", None], keys.strict_date) == [day, None, None, None, None]
    assert column(spark, ["01/02/2020", "1/2/2020", "31/02/2020"], keys.lenient_date) == [day, day, None]


def test_urls_and_titles(spark):
    viewer = "pdfjs/web/viewer.html?file=../../../ilims/upload/a%20b.pdf&embedded=true"
    base = "https://lom.agc.gov.my/"
    assert column(spark, [viewer, "http://x/y.pdf", "/ilims/z.pdf", "", "viewer.html?x=1"], keys.pdf_url) == [base + "ilims/upload/a b.pdf", "http://x/y.pdf", base + "ilims/z.pdf", "", ""]
    assert column(spark, ["http://h/a b%20c?d=é&e=1"], keys.encode_url) == ["http://h/a%20b%20c?d=%C3%A9&e=1"]
    got = column(spark, ['<a href="?lang=BM">B</a><a href="?lang=BI">E</a>', "<b>only</b> text"], keys.split_title)
    assert [tuple(x) for x in got] == [("B", "E"), ("", "only text")]


def test_ranges(spark):
    assert column(spark, ["3 to 5", "5-3", "1 to 500", "7A to 9"], keys.expand_range) == [[3, 4, 5], None, None, None]


def test_policies(spark):
    drafts = ["You should sue. This does not constitute legal advice.", "Fine.", "Am I liable? You must go.", "x does not constitute LEGAL advice"]
    assert column(spark, drafts, policy.policy_violations) == [[policy.NO_ADVICE], [policy.NO_DISCLAIMER], [policy.ESCALATED], []]
    assert column(spark, ["My client pays", "a client"], policy.is_escalation) == [True, False]
    assert column(spark, ["Apa itu", "danger"], policy.has_word) == [False, True]  # words count inside words
    trace = spark.createDataFrame([(["a", "b", "c"],), (["b", "a"],), (None,)], "t array<string>")
    assert [r[0] for r in trace.select(policy.is_subsequence(F.col("t"), F.array(F.lit("a"), F.lit("c")))).collect()] == [True, False, False]


def test_wording(spark):
    assert column(spark, ["don’t re–enter", "Employer's 60D"], values.tokens) == [["don't", "re-enter"], ["employer's", "60d"]]
    df = udfs.nfkc_casefold(spark.createDataFrame([("Straße ﬁx",), ("ABC",), (None,)], "t string"), "t", "f")
    assert {r.t: r.f for r in df.collect()} == {"Straße ﬁx": "strasse fix", "ABC": "abc", None: None}


def test_sections(spark):
    long = "text " * 20
    lines = [("d", 1, 0, "Short title"), ("d", 1, 1, "1. " + long), ("d", 1, 2, "more"), ("d", 2, 3, "2. too short"), ("d", 2, 4, "(a) note"), ("d", 3, 5, "1. again " + long)]
    df = spark.createDataFrame(lines, "document_id string, page_number int, pos int, line string")
    rows = segment.segment(df).orderBy("opened_at").collect()
    assert [(r.section_number, r.page_start, r.page_end) for r in rows] == [("1", 1, 2), ("2", 2, 3), ("1", 3, 3)]
    assert rows[0].content.split("\n") == ["Short title", "1. " + long, "more"]
    assert rows[2].content == "1. again " + long  # a line that opens with a bracket is no title
    kept = segment.chunk_sections(df).collect()
    assert [(r.section_number, r.chunk_ordinal, r.page_start) for r in kept] == [("1", 0, 3)]


def test_page_groups(spark):
    texts = ["cover", "An Act\n1. This Act", "body", "FIRST SCHEDULE", "more", "LIST OF AMENDMENTS"]
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "document_id string, page_number int, text string")
    assert [(r.page_number, r.part) for r in segment.page_groups(df).orderBy("page_number").collect()] == [(2, "main"), (3, "main"), (4, "schedules"), (5, "schedules")]


@pytest.mark.parametrize(("budget", "kept"), [(0, [4, 5]), (25, [2, 3, 4, 5]), (1000, [0, 1, 2, 3, 4, 5])])
def test_history_keeps_whole_turns(spark, budget, kept):
    df = spark.createDataFrame([(1, p, "user" if p % 2 == 0 else "assistant", 6) for p in range(6)], "thread_id int, pos int, role string, tokens int")
    assert sorted(r.pos for r in memory.trim_history(df, budget).collect()) == kept


def test_history_skips_a_leading_reply(spark):
    df = spark.createDataFrame([(1, 0, "assistant", 1), (1, 1, "user", 1), (1, 2, "assistant", 1)], "thread_id int, pos int, role string, tokens int")
    assert sorted(r.pos for r in memory.trim_history(df, 10).collect()) == [1, 2]


def test_rollbacks_toggle(spark):
    log = [("1", "en", i, a, x) for i, (a, x) in enumerate([("rollback", None), ("activate", "a"), ("activate", "b"), ("rollback", None), ("rollback", None)])]
    df = spark.createDataFrame(log, "act_number string, language string, seq long, action string, extraction_id string")
    assert [(r.seq, r.extraction_id, r.previous_id) for r in registry.activation_state(df).orderBy("seq").collect()] == [(1, "a", None), (2, "b", "a"), (3, "a", "b"), (4, "b", "a")]


def test_upsert_quarantines_conflicts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", None, "x")], "id string, size int, note string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", None, "y"), ("c", 3, "y")], "id string, size int, note string")
    table, conflicts = registry.upsert_immutable(old, new, "id", ["size"], ["note"])
    assert sorted(map(tuple, table.collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 3, "y")]
    assert [tuple(r) for r in conflicts.collect()] == [("a", 2)]


def test_pooling_errors(spark):
    rows = [("one", 1, [3.0, 4.0]), ("two", 1, [1.0, 0.0]), ("two", 3, [0.0, 1.0]), ("zero", 1, [1.0]), ("zero", 1, [-1.0]), ("odd", 1, [1.0]), ("odd", 1, [1.0, 2.0])]
    got = {r.chunk_id: r for r in memory.pool_embeddings(spark.createDataFrame(rows, "chunk_id string, weight int, embedding array<double>")).collect()}
    assert got["one"].embedding == [3.0, 4.0]
    assert got["two"].embedding == pytest.approx([0.25 / 0.625**0.5, 0.75 / 0.625**0.5])
    assert (got["zero"].error, got["odd"].error) == ("zero_magnitude", "inconsistent_dimensions")


def test_select_cases_refuses_empty_subsets(spark):
    cases = spark.createDataFrame([("a", "en", False)], "id string, category string, smoke boolean")
    assert evals.select_cases(cases, {"category": "en"}).count() == 1
    for bad in ("smoke", {"category": "xx"}, "other", {}):
        with pytest.raises(ValueError):
            evals.select_cases(cases, bad)


def test_locate(spark):
    text = ["pay", "the", "wag-", "es", "now", "pay", "the", "sum"]
    words = spark.createDataFrame([("d", 1, 0, i // 3, i, w, 10.0 * (i % 3), 0.0, 10.0 * (i % 3) + 5, 10.0) for i, w in enumerate(text)], "doc_id string, page int, block int, line int, n int, raw string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0)], "doc_id string, page int, width double, height double")
    quotes = spark.createDataFrame([(1, "d", 1, ["wages", "now"]), (2, "d", 1, ["pay", "the"]), (3, "d", 1, ["sum", "now"]), (4, "d", 2, ["wages", "now"])], "quote_id int, doc_id string, start_page int, tokens array<string>")
    got = {r.quote_id: r for r in phrases.locate(quotes, words, pages).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "matched", 2: "ambiguous", 3: "not_found", 4: "not_found"}
    assert [(b.line, b.x, b.width) for b in got[1].rectangles] == [(0, 0.2, 0.05), (1, 0.0, 0.15)]


def test_tokens_fold_compatible_spellings(spark):
    df = spark.createDataFrame([(1, "The ﬁrst ＦＵＬＬ‐width Straße"), (2, "the first full-width strasse"), (3, "")], "id int, text string")
    got = {r.id: r.tokens for r in phrases.token_table(df, "id", "text").collect()}
    assert got[1] == got[2] == ["the", "first", "full-width", "strasse"] and got[3] == []


def test_quotes_are_looked_for_by_their_rarest_tokens(spark):
    """All texts and quotes share an opening of eight tokens; short quotes and repeated places too."""
    opening = "be it enacted by the king and by".split()
    docs = [(i, opening + [f"w{i}", f"v{i % 7}", "end", "the", "king"]) for i in range(200)] + [(200, []), (201, ["the"])]
    quotes = [(i, opening + [f"w{i}", f"v{i % 7}"]) for i in range(0, 200, 9)] + [(900, ["the", "king"]), (901, opening + ["nowhere"]), (902, ["w3"]), (903, [])]
    d, q = spark.createDataFrame(docs, "doc_id long, tokens array<string>"), spark.createDataFrame(quotes, "quote_id long, tokens array<string>")
    want = sorted((n, i, p) for n, x in quotes for i, t in docs for p in range(len(t)) if x and t[p : p + len(x)] == x)
    assert sorted(map(tuple, phrases.phrase_matches(q, d).collect())) == want
    # One row for each long quote, none for the opening.
    assert phrases.seeds(q.filter("quote_id < 900 OR quote_id = 901"), d).count() == 23
    own = q.filter("quote_id < 900").withColumn("doc_id", F.col("quote_id") + F.when(F.col("quote_id") == 9, 1).otherwise(0))
    assert sorted(map(tuple, phrases.phrase_matches(own, d).collect())) == [(i, i, 0) for i in range(0, 200, 9) if i != 9]


def test_names_meet_titles_by_their_rarest_characters(spark):
    titles = [f"Act of the Matter of Number {i} and Others" for i in range(150)] + ["Tax", "", None, "Taxation"]
    names = ["act of the matter of number 7", "number 149 and", "tax", "x", "act of the matter of nothing", "taxation of"]
    t, n = spark.createDataFrame([(x,) for x in titles], "act_title string"), spark.createDataFrame([(x,) for x in names], "_name string")
    want = sorted((x, y) for x in names for y in titles if y is not None and x in y.lower())
    assert sorted(map(tuple, lookup.titles_holding(t, n).collect())) == want


def test_rollout_with_rival_versions(spark):
    """The mapping decides between ready versions; without one they are ambiguous, and a failure says so."""
    docs = spark.createDataFrame([(d, a, "en") for d, a in (("old", "1"), ("new", "1"), ("p", "2"), ("q", "2"), ("r", "3"), ("s", "4"))], "document_id string, act_number string, language string")
    runs = spark.createDataFrame([(d, f"x-{d}", 1, "pending" if d == "s" else "ready") for d in ("old", "new", "p", "q", "r", "s")], "document_id string, extraction_id string, chunk_count int, status string")
    chunks = spark.createDataFrame([(f"x-{d}",) for d in ("old", "new", "p", "r")], "extraction_id string")
    active = spark.createDataFrame([("1", "en", "new", "x-new")], "act_number string, language string, document_id string, extraction_id string")
    got = {r.document_id: (r.step, r.failure) for r in registry.rollout_plan(docs, runs, chunks, active).collect()}
    rival = ("ambiguous", "several ready versions and no active mapping")
    assert got == {"old": ("superseded", None), "new": ("done", None), "p": rival, "q": rival, "r": ("activate", None), "s": ("prepare", "no ready extraction")}
    counts = registry.rollout_counts(registry.rollout_plan(docs, runs, chunks, active)).first()
    assert (counts.candidates, counts.ambiguous, counts.superseded, counts.done) == (6, 2, 1, 1)


def test_latin_1_is_folded_without_python(spark, monkeypatch):
    import unicodedata

    texts = [chr(n) for n in range(0x2000)] + ["e\u0301", "Straße É", "É\n", "ABC\u0301", "ΟΔΟΣ", "ﬁ½ Ａ"]
    want = [unicodedata.normalize("NFKC", t).casefold() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.f for r in udfs.nfkc_casefold(df, "t", "f").orderBy("i").collect()] == want

    @F.pandas_udf("string")
    def refused(t):
        raise AssertionError("sent to Python")

    monkeypatch.setattr(udfs, "_fold", refused)
    plain = spark.createDataFrame([("Straße É",), ("ÀÖØÞ¿\nÑ",), (None,)], "t string")
    assert [r.f for r in udfs.nfkc_casefold(plain, "t", "f").collect()] == ["strasse é", "àöøþ¿\nñ", None]


def test_an_embedder_runs_once_a_text(spark):
    """Exploding the vectors had Spark embed each text a second time, for a filter on the vector's size."""
    from hashlib import sha256

    import numpy as np
    import pyarrow as pa

    texts = ["one two two", "", None, "Three-four o'clock one", *(f"w{i} w{i % 7} x" for i in range(40))]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for lists in batches:
            seen.add(len(lists))
            yield lists.map(lambda words: [1.0, float(len(words))])

    got = udfs.embed(data, "text", embedder=counting).select("doc_id", F.posexplode("embedding").alias("place", "x")).filter("x <> 0").collect()
    assert seen.value == len(texts) and (0, 1, 3.0) in map(tuple, got)
    assert str(udfs.embed(data, "text").select(F.posexplode("embedding"))._jdf.queryExecution().optimizedPlan()).count("ArrowEvalPython") == 1
    for row in udfs.embed(data, "text").collect():
        want = np.zeros(64)
        for word in (row.text or "").lower().split():
            want[int.from_bytes(sha256(word.encode()).digest()[:4], "big") % 64] += 1
        assert row.embedding == (want / (np.linalg.norm(want) or 1)).astype(np.float32).tolist()
    some = pa.array([["a"], [], None, ["b", "a"], ["c"]])
    batches = [list(udfs.hashed_bag(rows=n)(iter([some.slice(0, 3), some.slice(3)]))) for n in (1, 2, 512)]
    assert batches[0] == batches[1] == batches[2] and [len(b) for b in batches[0]] == [3, 2]
