"""What plans of queries do once, and how they deal out their rows."""

from twins import DATA

from corpuslake import plans
from corpuslake.functions import udfs
from corpuslake.operators import graph, phrases, segment
from corpuslake.plans.views import Views


def optimized(spark, name):
    return plans.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_q5_deals_lines_to_as_many_tasks_as_a_shuffle_has(spark):
    dealt = [line for line in optimized(spark, "q5_fingerprint").splitlines() if "RepartitionByExpression" in line]
    assert dealt and all(line.rstrip().endswith("]") for line in dealt)


def test_j12_makes_spans_and_nodes_once(spark):
    assert "parquet" not in optimized(spark, "j12_nested_owner")


def test_pages_of_statutes_are_made_once(spark):
    assert all("parquet" not in t._jdf.queryExecution().optimizedPlan().toString() for t in Views(spark, DATA).statutes)


def test_j13_deals_words_out_once(spark):
    """Tokens and words are shuffled by page together; nothing but the spans is shuffled beside them."""
    plan = plans.QUERIES["j13_words_for_spans"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_words_for_spans_where_pages_differ(spark):
    tokens = [(1, 1, 0, "a", 0, 9), (1, 1, 1, "b", 10, 19), (1, 2, 2, "c", 0, 9), (1, 2, 3, "d", 10, 19), (2, 1, 0, "a", 0, 9), (3, 1, 0, "a", 0, 9), (3, 1, 1, None, 10, 19)]
    words = [(1, 1, 0, "A"), (1, 1, 1, "b"), (1, 2, 2, "c"), (1, 2, 3, "x"), (2, 1, 0, "a"), (2, 1, 1, "more"), (3, 1, 0, "a"), (3, 1, 1, "b")]
    spans = [(f"{d}-{p}", d, p, 5, 15) for d in (1, 2, 3) for p in (1, 2)]
    t = spark.createDataFrame(tokens, "doc_id long, page int, position int, token string, first int, last int")
    w = spark.createDataFrame(words, "doc_id long, page int, n int, raw string")
    s = spark.createDataFrame(spans, "span_id string, doc_id long, page int, start int, end int")
    assert sorted(map(tuple, phrases.words_for_spans(s, t, w).collect())) == [("1-1", 1, 1, 0), ("1-1", 1, 1, 1)]


def test_j10_makes_chunks_once(spark):
    assert "parquet" not in optimized(spark, "j10_attach_evidence")


def test_matches_without_lines_copy_none(spark):
    texts = spark.createDataFrame([(1, "a 1 b 22\n3")], "k int, text string")
    got = [(r.literal, r.line) for r in udfs.matches(texts, "text", (("number", "[0-9]+"),), lines=False).collect()]
    assert got == [("1", None), ("22", None), ("3", None)]
    assert {r.line for r in udfs.matches(texts, "text", (("number", "[0-9]+"),)).collect()} == {"a 1 b 22", "3"}


def test_nodes_are_placed_without_their_texts(spark):
    """Pages are dealt out once, and a document's text once for its nodes; what asks for no texts meets none."""
    pages, documents = Views(spark, DATA).statutes
    tree = graph.provision_tree(pages, documents)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" in plan(tree) and "substr" not in plan(tree.drop("text"))
    _, edges, unresolved, candidates = graph.graph_of_pages(pages, documents)
    # References are kept once made: none of these goes back to texts.
    assert all("MapInArrow" not in plan(t) for t in (edges, unresolved, candidates))
    grouped = plan(segment.page_groups(pages, "document_id"))
    assert not [line for line in grouped.splitlines() if "Window" in line and "text#" in line]


def test_parts_of_statutes_are_dealt_out_once(spark, monkeypatch):
    """Pages and documents are shuffled by document, once each: no page meets its group by a join."""
    kept = []
    monkeypatch.setattr(graph, "checkpointed", lambda df: kept.append(df) or df)
    pages = spark.createDataFrame([("d", 1, "An Act\n1. Short title")], "document_id string, page_number int, text string")
    graph._parts(pages, spark.createDataFrame([("d", "1")], "document_id string, act_number string"), "document_id")
    assert kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(document_id") == 2
