from pyspark.sql import functions as F

from corpuslake.operators import graph, quality


def lexed(spark, text):
    df = spark.createDataFrame([("p", text)], "provision_id string, text string")
    return [(r.kind, r.literal) for r in graph.lex_references(df).orderBy("start_offset").collect()]


def test_lexer(spark):
    assert lexed(spark, "subject to section 60D and paragraph (a), see Part II") == [("section", "section 60D"), ("paragraph", "paragraph (a)"), ("part", "Part II")]
    assert lexed(spark, "PART IV\nunder this Act and the Courts Act 1951 [Act 369]") == [("act", "this Act"), ("act", "the Courts Act 1951 [Act 369]")]
    assert lexed(spark, "section 5 of the Courts Act 1951 [Act 369] applies") == [("section", "section 5 of the Courts Act 1951 [Act 369]")]
    assert lexed(spark, "under sections 3 to 5 of this Act") == [("section", "sections 3 to 5 of this Act")]
    assert lexed(spark, "") == []


def test_targets(spark):
    rows = [(1, "act:1/section:7/subsection:1", "section", "section 3 to 5"), (2, "act:1/section:7", "section", "section 60(2)"), (3, "act:1/section:7", "subsection", "subsection (2)"), (4, "act:1/section:7/subsection:1/paragraph:b", "paragraph", "paragraph (a)"), (5, "act:1/section:7", "paragraph", "paragraph (a)"), (6, "act:1/section:7", "section", "section 5 of the Courts Act 1951 [Act 369]"), (7, "act:1/section:7", "part", "Part II"), (8, "act:1/section:7", "section", "section 9 to 3")]
    df = graph.reference_targets(spark.createDataFrame(rows, "candidate_id int, source_provision_id string, kind string, literal string"))
    got = {r.candidate_id: (r.targets, r.reason) for r in df.collect()}
    assert got[1][0] == [f"act:1/section:{n}" for n in (3, 4, 5)]
    assert got[2][0] == ["act:1/section:60", "act:1/section:2"]
    assert got[3][0] == ["act:1/section:7/subsection:2"]
    assert got[4][0] == ["act:1/section:7/subsection:1/paragraph:a"]
    assert got[5][1] == "relative_context_missing"
    assert got[6][0] == ["act:369/section:5"]
    assert got[7][0] == ["act:1/description:part-ii"]
    assert got[8][1] == "malformed_range"
    strict = graph.reference_targets(spark.createDataFrame(rows[1:2], "candidate_id int, source_provision_id string, kind string, literal string"), strict=True)
    assert strict.first().targets == ["act:1/section:60"]


def test_provisions(spark):
    text = "1. (1) Short title.\n(a) first\n(b) second\n(2) Next.\n2. Other thing\n(i) roman\n1. Again"
    df = graph.parse_provisions(spark.createDataFrame([("d", "5", text)], "document_id string, act_number string, text string"))
    got = {r.provision_id: text[r.start : r.end] for r in df.collect()}
    assert set(got) == {"act:5/section:1", "act:5/section:1/subsection:1", "act:5/section:1/subsection:1/paragraph:a", "act:5/section:1/subsection:1/paragraph:b", "act:5/section:1/subsection:2", "act:5/section:2"}
    assert got["act:5/section:2"].startswith("2. Other") and "Again" not in got["act:5/section:2"]
    assert "(a) first" in got["act:5/section:1/subsection:1/paragraph:a"] and "second" not in got["act:5/section:1/subsection:1/paragraph:a"]


PAGES = ["Cover", "An Act relating to work.\n1. (1) Short title.\n(a) first, see section 2 on it\n(i) small\n(ii) smaller\n(b) second", "PART II\n2. Interpretation under section 9.\n(c) no paragraph of any subsection", "2. Again, as section 8 of the Holidays Act 1951 [Act 369] says", "FIRST SCHEDULE\nForms", "more forms under section 2\nSECOND SCHEDULE\nFees", "LIST OF AMENDMENTS"]


def test_tree_and_graph_of_pages(spark):
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(PAGES)] + [("none", 1, "1. No opening")], "document_id string, page_number int, text string")
    docs = spark.createDataFrame([("d", "5", "WORK ACT 1955", 7), ("none", "6", "X", 1)], "document_id string, act_number string, act_title string, page_count int")
    provisions, edges, unresolved, candidates = (t.cache() for t in graph.graph_of_pages(pages, docs))
    rows = {r.provision_id.removeprefix("act:5"): r for r in provisions.collect()}
    assert {k: (r.label, r.page_start, r.page_end) for k, r in rows.items()} == {
        "": ("Act 5", 1, 7),
        "/section:1": ("Section 1", 2, 3),
        "/section:1/subsection:1": ("Section 1(1)", 2, 3),
        "/section:1/subsection:1/paragraph:a": ("Section 1(1)(a)", 2, 3),
        "/section:1/subsection:1/paragraph:a/subparagraph:i": ("Section 1(1)(a)(i)", 2, 3),
        "/section:1/subsection:1/paragraph:a/subparagraph:ii": ("Section 1(1)(a)(ii)", 2, 3),
        "/section:1/subsection:1/paragraph:b": ("Section 1(1)(b)", 2, 3),
        "/section:2": ("Section 2", 3, 3),  # up to its number on the next page, where it is repeated
        "/description:part-ii": ("Part II", 3, 3),
        "/schedule:first": ("First Schedule", 5, 6),
        "/schedule:second": ("Second Schedule", 6, 6),
    }
    assert rows["/section:1/subsection:1/paragraph:a/subparagraph:ii"].text.strip() == "(ii) smaller"
    assert rows["/section:1/subsection:1/paragraph:a"].parent_id == "act:5/section:1/subsection:1"
    assert rows["/section:2"].text.startswith("2. Interpretation") and "Again" not in rows["/section:2"].text
    assert rows["/section:2"].version_id == "d/provision:act:5/section:2"
    got = {(r.source_provision_id.removeprefix("act:5"), r.target_provision_id): r for r in edges.collect()}
    assert set(got) == {("/section:1/subsection:1/paragraph:a", "act:5/section:2"), ("/schedule:first", "act:5/section:2")}
    own = got["/section:1/subsection:1/paragraph:a", "act:5/section:2"]
    assert rows["/section:1/subsection:1/paragraph:a"].text[own.start_offset : own.end_offset] == own.literal == "section 2"
    assert (own.target_version_id, own.evidence.pages[0].page_number, own.evidence.text) == ("d/provision:act:5/section:2", 2, "section 2")
    assert got["/schedule:first", "act:5/section:2"].evidence.pages[0].page_number == 6
    assert [(r.source_provision_id, r.reason_code) for r in unresolved.collect()] == [("act:5/section:2", "target_not_indexed")]
    assert candidates.count() == 3


def test_build_and_diff(spark):
    def build(body):
        df = spark.createDataFrame([("d", "5", body)], "document_id string, act_number string, text string")
        return graph.build_graph(df)

    provisions, edges, unresolved = build("1. See section 2.\n2. See section 9 and this Act.")
    assert provisions.count() == 2
    assert {r.target_provision_id for r in edges.collect()} == {"act:5/section:2", "act:5"}
    assert [r.reason for r in unresolved.collect()] == ["target_not_indexed"]
    paged = edges.withColumn("page_number", F.lit(1))
    other = build("1. See  section 2.\n2. See nothing.")[1].withColumn("page_number", F.lit(1))
    assert sorted(r.status for r in graph.compare_snapshots(paged, other).collect()) == ["removed", "unchanged"]
    assert quality.validate_graph(provisions, edges, unresolved).count() == 0


def test_follow_is_capped_and_ordered(spark):
    edges = spark.createDataFrame([(f"e{i}", "act:1/section:1", f"act:1/section:{i}", "section", f"section {i}", i, "d", "x") for i in range(2, 10)], "edge_id string, source_provision_id string, target_provision_id string, reference_kind string, literal string, start_offset int, document_id string, extraction_id string")
    targets = spark.createDataFrame([("1", "2", "d", "x"), ("1", "3", "other", "x")], "act_number string, section_number string, document_id string, extraction_id string")
    anchors = spark.createDataFrame([("a", "act:1/section:1", "d", "x")], "anchor_id string, provision_id string, document_id string, extraction_id string")
    got = graph.follow_references(anchors, edges, targets, max_edges=99).orderBy("n").collect()
    assert [r.edge_id for r in got] == ["e2", "e3", "e4", "e5", "e6"]
    assert [r.found for r in got] == [True, False, False, False, False]


def test_identity_guard(spark):
    rows = [("1", "d1", "x", 0), ("1", "d1", "x", 1), ("2", "d1", "x", 0), ("2", "d2", "x", 1)]
    df = spark.createDataFrame(rows, "label string, document_id string, extraction_id string, chunk_ordinal int")
    assert [(r.label, r.chunk_ordinal) for r in graph.unique_identity(df, ["label"]).collect()] == [("1", 0)]


def test_versions_of_an_act_are_checked_each_on_its_own(spark):
    """Two versions of one act share all ids; what one lacks the other doesn't hide."""
    of = "document_id string, provision_id string, kind string, parent_id string, start int, end int"
    rows = [("act:1", "act", None), ("act:1/section:1", "section", "act:1"), ("act:1/section:1/subsection:1", "subsection", "act:1/section:1"), ("act:1/section:2", "section", "act:1")]
    edge = ("e1", "act:1/section:1", "act:1/section:2", "explicit_reference", "section 2", 0, 9)
    graphs = {d: [(d, *r, 0, 9) for r in rows] for d in ("v1", "v2")}
    edges = spark.createDataFrame([(d, *edge) for d in graphs], "document_id string, edge_id string, source_provision_id string, target_provision_id string, relationship string, literal string, start_offset int, end_offset int")
    loose = spark.createDataFrame([("v2", "act:1/section:2", "target_not_indexed")], "document_id string, source_provision_id string, reason string")
    found = lambda nodes: sorted((r.code, r.subject) for r in quality.validate_graph(spark.createDataFrame(nodes, of), edges, loose).collect())
    assert found(graphs["v1"] + graphs["v2"]) == []
    lacking = graphs["v1"] + [r for r in graphs["v2"] if r[1] not in ("act:1/section:1", "act:1/section:2")]
    assert found(lacking) == [("edge_source", "e1"), ("edge_target", "e1"), ("provision_parent", "act:1/section:1/subsection:1"), ("unresolved_source", "act:1/section:2")]
    assert found(graphs["v1"] * 2 + graphs["v2"]) == [("provision_duplicate", r[0]) for r in rows]


def test_owners_and_pages_by_one_pass(spark):
    """Nested nodes and spans of many documents against all pairs; documents with overlapping nodes, unknown kinds or falling page numbers too."""
    import random

    rng, nodes, spans, pages = random.Random(3), [], [], []
    for d in range(12):
        at = 0
        for s in range(8):
            end = at + rng.randrange(20, 60)
            nodes.append((d, f"act:1/section:{s}", at, end + (15 if d == 10 else 0)))
            cuts = sorted(rng.sample(range(at, end), 4))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                nodes.append((d, f"act:1/section:{s}/subsection:{i}", a, b))
                if b - a > 4:
                    nodes.append((d, f"act:1/section:{s}/subsection:{i}/paragraph:a", a + 1, b - 1))
            nodes.append((d, f"act:1/{'odd' if d == 11 else 'description'}:part-{s}", at + 2, at + 9))
            at = end
        nodes.append((d, "act:1", 0, at))
        for i in range(60):
            a = rng.randrange(at)
            spans.append((d, f"s{i}", a, a + rng.randrange(0, 12)))
        edges = [0, *sorted(rng.sample(range(1, at), 5)), at]
        pages += [(d, (9 - n if d == 9 else n), a, b - a) for n, (a, b) in enumerate(zip(edges, edges[1:]))]
    node_rows = spark.createDataFrame(nodes, "document_id int, provision_id string, start int, end int")
    span_rows = spark.createDataFrame(spans, "document_id int, span_id string, start int, end int")
    want = {}
    for d, i, a, b in spans:
        held = [(-p.count("/"), p) for e, p, s, t in nodes if e == d and s <= a and t >= b]
        if held:
            want[d, i] = min(held)[1]
    assert {(r.document_id, r.span_id): r.owner for r in graph.nested_owner(span_rows, node_rows).collect()} == want
    on = {}
    for d, i, a, b in spans:
        met = [n for e, n, s, size in pages if e == d and s < b and s + size >= a]
        if met:
            on[d, i] = (min(met), max(met))
    page_rows = spark.createDataFrame(pages, "document_id int, page_number int, page_offset int, page_length int")
    assert {(r.document_id, r.span_id): (r.page_start, r.page_end) for r in graph.pages_for_spans(span_rows, page_rows).collect()} == on


def test_one_large_document_takes_rows_in_proportion(spark):
    """100,000 nodes and as many spans in one document: no operator makes rows for their pairs."""
    n = 100_000
    nodes = spark.range(n).selectExpr("1 AS document_id", "concat('act:1/section:', id) AS provision_id", "id * 10 AS start", "id * 10 + 10 AS end")
    spans = spark.range(n).selectExpr("1 AS document_id", "id AS span_id", "id * 10 + 2 AS start", "id * 10 + 5 AS end")
    found = graph.nested_owner(spans, nodes)
    assert found.filter("owner = concat('act:1/section:', span_id)").count() == n
