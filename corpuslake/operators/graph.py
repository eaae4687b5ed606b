"""The reference graph: provisions, lexed references, resolution, neighbourhoods and snapshot diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.keys import candidate_id, edge_id, expand_range, in_scope, path_act, path_depth, path_section
from corpuslake.functions.udfs import matches
from corpuslake.functions.values import normalize_wording
from corpuslake.operators.segment import first_wins, page_groups, with_ordinal
from corpuslake.sources.scratch import checkpointed

LOGICAL = ["source_provision_id", "target_provision_id", "reference_kind", "relationship", "literal_wording"]
MOST_EDGES = 5
#: How headings and references are written.
HEADINGS = (
    ("section", r"(?mi)^\s*(?P<label>\d{1,3}[A-Z]{0,2})\.\s*(?=(?:\(\d+[A-Z]?\)|[A-Z]))"),
    ("first", r"(?mi)^\s*\d{1,3}[A-Z]{0,2}\.\s*\((?P<label>\d+[A-Z]?)\)\s+"),
    ("subsection", r"(?mi)^\s*\((?P<label>\d+[A-Z]?)\)\s+"),
    ("paragraph", r"(?m)^\s*\((?P<label>[a-z]{1,3})\)\s+"),
    ("subparagraph", r"(?mi)^\s*\((?P<label>[ivxlcdm]+)\)\s+"),
    ("description", r"(?mi)^\s*PART\s+(?P<label>[XIVLCDM]+[A-Z]?)\s*$"),
)
SCHEDULES = (("schedule", r"(?mi)^\s*(?P<label>FIRST|SECOND)\s+SCHEDULE\s*$"), ("table", r"TABLE OF AMENDMENTS"))
NOT_LETTERS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
_ITEM = r"(?:\d{1,3}[A-Z]{0,2}(?:\s*\([^)]*\))?|\([^)]*\)|[IVXLCDM]+|First|Second)"
REFERENCES = (
    ("reference", rf"(?i)\b(?:sections?|subsections?|paragraphs?|subparagraphs?|Parts?|Schedules?)\s+{_ITEM}(?:\s*(?:,|and|or|to|–|-)\s*{_ITEM})*(?:\s+of\s+(?:this Act|the [A-Z][^.\[\n]*? Act \d{{4}}\s*\[Act\s+\d+\]))?(?![A-Za-z])"),
    ("act", r"\b(?:the\s+)?(?:[A-Z][A-Za-z’'\-]*\s+){0,14}Act\s+\d{4}\s*\[Act\s+\d+\]"),
    ("act", r"(?i)\bthis Act\b"),
)


def lex_references(provisions: DataFrame, key: str = "provision_id", text: str = "text") -> DataFrame:
    """key, kind, literal, start_offset, end_offset of every explicit reference; lines that are nothing but the
    reference (headings) don't count, nor do act names inside a longer reference."""
    return _references(provisions.select(key, F.col(text).alias("text")), [key])


def _references(texts: DataFrame, keys: list[str]) -> DataFrame:
    found = matches(texts, "text", REFERENCES)
    real = found.filter(F.lower(F.trim("literal")) != F.lower("line")).withColumn("rank", F.when(F.col("kind") == "reference", 0).otherwise(1))
    # Longer spans of the same text that begin no later and end no earlier cover an act's name.
    so_far = Window.partitionBy(*keys).orderBy("first", F.desc("last"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("kind") == "reference", F.col("last"))).over(so_far)
    kept = real.withColumn("reach", reach).filter("kind = 'reference' OR reach IS NULL OR last > reach")
    kind = F.when(F.col("kind") == "act", "act").otherwise(F.regexp_replace(F.lower(F.regexp_extract("literal", r"^(\w+)", 1)), "s$", ""))
    return kept.select(*keys, kind.alias("kind"), "literal", F.col("first").alias("start_offset"), F.col("last").alias("end_offset")).distinct()


LEVELS = ("section", "subsection", "paragraph", "subparagraph")


def _nodes(texts: DataFrame, key: str) -> DataFrame:
    """key, provision_id, kind, label, parent_id, start, end, section_at of sections and what is in them, and of Part headings; ``texts``: key, act, text.

    Every heading belongs to the last one before it on each level above; a node ends where the next of its level under the same parent starts, or
    where the parent ends. Of repeated ids the first stays."""
    found = matches(texts.withColumn("size", F.length("text")), "text", HEADINGS)
    at = F.when(F.col("kind") == "first", F.col("label_at") - 1).otherwise(F.col("first")).alias("start")
    kind = F.when(F.col("kind") == "first", "subsection").otherwise(F.col("kind"))
    rows = found.select(key, "act", "size", kind.alias("kind"), "label", at, F.col("last").alias("past"))
    is_letter = F.col("label").rlike("^[a-z]{1,3}$") & ~F.col("label").isin(*NOT_LETTERS)
    rows = rows.filter(((F.col("kind") != "paragraph") | is_letter) & ((F.col("kind") != "subparagraph") | ~is_letter))
    label = F.when(F.col("kind").isin("section", "subsection", "description"), F.upper("label")).when(F.col("kind") == "subparagraph", F.lower("label")).otherwise(F.col("label"))
    level = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(LEVELS)), F.lit(9))
    rows = rows.withColumn("label", label).withColumn("level", level)
    along = Window.partitionBy(key).orderBy("start", "level").rowsBetween(Window.unboundedPreceding, 0)
    for i, k in enumerate(LEVELS):
        last = F.last(F.when(F.col("level") == i, F.struct(F.col("label").alias("label"), F.col("start").alias("at"))), ignorenulls=True).over(along)
        rows = rows.withColumn(k, last)
    for k, above in zip(LEVELS[1:], LEVELS):
        rows = rows.withColumn(k, F.when(F.col(f"{k}.at") >= F.col(f"{above}.at"), F.col(k)))
    placed = rows.filter(reduce(lambda a, b: a | b, ((F.col("level") == i) & F.col(k).isNotNull() & F.col(LEVELS[max(i - 1, 0)]).isNotNull() for i, k in enumerate(LEVELS))) | (F.col("level") == 9))
    root = F.concat(F.lit("act:"), "act")
    ids, names, parents = root, F.lit(""), {}
    made_id, made_name, parent = F.concat(root, F.lit("/description:part-"), F.lower("label")), F.concat(F.lit("Part "), "label"), root
    for i, k in enumerate(LEVELS):
        parents[k] = ids
        ids = F.concat(ids, F.lit(f"/{k}:"), F.col(f"{k}.label"))
        names = F.concat(F.lit("Section "), F.col("section.label")) if i == 0 else F.concat(names, F.lit("("), F.col(f"{k}.label"), F.lit(")"))
        made_id, made_name, parent = F.when(F.col("level") == i, ids).otherwise(made_id), F.when(F.col("level") == i, names).otherwise(made_name), F.when(F.col("level") == i, parents[k]).otherwise(parent)
    nodes = placed.select(key, made_id.alias("provision_id"), "kind", made_name.alias("label"), parent.alias("parent_id"), "start", "past", "size", "level", *(F.col(f"{k}.at").alias(f"{k}_at") for k in LEVELS))
    whole = F.col("size")
    for i, k in enumerate(LEVELS):
        of = [f"{LEVELS[j]}_at" for j in range(i)]
        following = F.when(F.col("level") == i, F.lead("start").over(Window.partitionBy(key, "level", *of).orderBy("start")))
        nodes = nodes.withColumn("_next", following)
        ends = F.max("_next").over(Window.partitionBy(key, *of, f"{k}_at"))
        nodes = nodes.withColumn(f"{k}_end", F.coalesce(ends, whole)).drop("_next")
        whole = F.col(f"{k}_end")
    end = F.coalesce(*(F.when(F.col("level") == i, F.col(f"{k}_end")) for i, k in enumerate(LEVELS)), F.col("past"))
    out = nodes.select(key, "provision_id", "kind", "label", "parent_id", "start", end.alias("end"), F.when(F.col("level") < 9, F.col("section_at")).otherwise(F.col("start")).alias("section_at"))
    return first_wins(out, [key, "provision_id"], ["start"])


def parse_provisions(texts: DataFrame, key: str = "document_id", act: str = "act_number", text: str = "text") -> DataFrame:
    """key, provision_id, kind, label, parent_id, start, end: sections, their subsections, paragraphs and subparagraphs, and Part headings, from one text a
    document."""
    return _nodes(texts.select(key, F.col(act).alias("act"), F.col(text).alias("text")), key).drop("section_at")


def _joined(pages: DataFrame, key: str) -> DataFrame:
    """key, part, text: the pages of a part, a line break between them."""
    listed = pages.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    return listed.select(key, "part", F.array_join("pages.text", "\n").alias("text"))


def _offsets(pages: DataFrame, key: str) -> DataFrame:
    """key, part, page_number, page_offset, page_length of the pages (key, part, page_number, page_length) in their part's text."""
    upto = F.sum(F.col("page_length") + 1).over(Window.partitionBy(key, "part").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0))
    return pages.select(key, "part", "page_number", (upto - F.col("page_length") - 1).alias("page_offset"), "page_length")


def _page_range(spans: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, page_start, page_end of spans (keys with part, start, end)."""
    met = spans.select(*keys, "start", "end").distinct().join(offsets, keys).filter("page_offset < end AND page_offset + page_length >= start")
    return met.groupBy(*keys, "start", "end").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))


def provision_tree(pages: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """key, provision_id, version_id, kind, label, parent_id, text, start, end, page_start, page_end, part of every node of a document: the act, its sections and
    what is in them, its Parts and schedules. ``pages``: key, page_number, text; ``documents``: key, act_number, act_title, page_count.

    The body and the schedules are texts of their own, with offsets of their own. What is in a section has the section's pages. Documents without
    an opening page have no nodes."""
    texts, offsets = _parts(pages, documents, key)
    return _with_text(_tree(texts, offsets, documents, key), texts, documents, key)


def _parts(pages: DataFrame, documents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, part, act, text; offsets) of the body and the schedules of each document: texts are dealt out and kept once."""
    listed = page_groups(pages, key, ["text"]).groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    sizes = F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), F.length(p["text"]).alias("page_length")))
    whole = listed.select(key, "part", F.array_join("pages.text", "\n").alias("text"), sizes.alias("sizes"))
    made = checkpointed(whole.join(documents.select(key, F.col("act_number").alias("act")), key))
    return made.select(key, "part", "act", "text"), checkpointed(_offsets(made.select(key, "part", F.inline("sizes")), key))


def _tree(joined: DataFrame, offsets: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The nodes of ``provision_tree`` without their texts."""
    of = documents.select(key, F.col("act_number").alias("act"), "act_title", "page_count")
    body = _nodes(joined.filter("part = 'main'").select(key, "act", "text"), key).withColumn("part", F.lit("main"))

    found = matches(joined.filter("part = 'schedules'").withColumn("size", F.length("text")).select(key, "act", "size", "text"), "text", SCHEDULES)
    per = Window.partitionBy(key)
    table = F.min(F.when(F.col("kind") == "table", F.col("first"))).over(per)
    marked = found.withColumn("stop", F.coalesce(table, F.col("size"))).filter("kind = 'schedule'")
    next_one = F.lead("first").over(per.orderBy("first"))
    name = F.initcap("label")
    schedules = marked.select(key, F.concat(F.lit("act:"), "act", F.lit("/schedule:"), F.lower("label")).alias("provision_id"), "kind", F.concat(name, F.lit(" Schedule")).alias("label"), F.concat(F.lit("act:"), "act").alias("parent_id"), F.col("first").alias("start"), F.coalesce(next_one, F.col("stop")).alias("end"))
    schedules = first_wins(schedules, [key, "provision_id"], ["start"]).select("*", F.col("start").alias("section_at"), F.lit("schedules").alias("part"))

    nodes = checkpointed(body.unionByName(schedules))
    # A section's pages are those of its own span, which its children take over.
    tops = nodes.filter("start = section_at AND kind IN ('section', 'description', 'schedule')")
    sections = _section_spans(joined, key)
    spans = tops.filter("kind <> 'section'").select(key, "part", "start", "end").unionByName(sections)
    ranges = _page_range(spans, offsets, [key, "part"]).select(key, "part", F.col("start").alias("section_at"), "page_start", "page_end")
    placed = nodes.join(ranges.dropDuplicates([key, "part", "section_at"]), [key, "part", "section_at"], "left")
    first_page = offsets.groupBy(key, "part").agg(F.min("page_number").alias("_first"))
    whole = placed.join(first_page, [key, "part"])
    whole = whole.withColumn("page_start", F.coalesce("page_start", "_first")).withColumn("page_end", F.coalesce("page_end", "_first"))
    columns = [key, "provision_id", "kind", "label", "parent_id", "start", "end", "page_start", "page_end", "part"]
    title = F.coalesce("act_title", F.lit(""))
    acts = of.join(joined.filter("part = 'main'").select(key), key, "left_semi").select(key, F.concat(F.lit("act:"), "act").alias("provision_id"), F.lit("act").alias("kind"), F.concat(F.lit("Act "), "act").alias("label"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("start"), F.length(title).alias("end"), F.lit(1).alias("page_start"), F.col("page_count").alias("page_end"), F.lit("title").alias("part"))
    every = acts.unionByName(whole.select(*columns))
    return every.select("*", F.concat(F.col(key), F.lit("/provision:"), "provision_id").alias("version_id"))


def _with_text(nodes: DataFrame, texts: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """``nodes`` with their texts, which hold one another: a text is met once a node, and only where it is asked for."""
    titles = documents.select(key, F.coalesce("act_title", F.lit("")).alias("_title"))
    met = nodes.join(texts.select(key, "part", F.col("text").alias("_all")), [key, "part"], "left").join(titles, key, "left")
    text = F.when(F.col("part") == "title", F.col("_title")).otherwise(F.substr("_all", F.col("start") + 1, F.col("end") - F.col("start")))
    columns = [key, "provision_id", "kind", "label", "parent_id", text.alias("text"), "start", "end", "page_start", "page_end", "part", "version_id"]
    return met.select(*columns)


def _section_spans(joined: DataFrame, key: str) -> DataFrame:
    """key, part, start, end of every section heading's span, repeated numbers included."""
    found = matches(joined.filter("part = 'main'").withColumn("size", F.length("text")).select(key, "part", "size", "text"), "text", HEADINGS[:1])
    following = F.lead("first").over(Window.partitionBy(key, "part").orderBy("first"))
    return found.select(key, "part", F.col("first").alias("start"), F.coalesce(following, F.col("size")).alias("end"))


def _apart(df: DataFrame, by: list[str], odd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the groups that are not in ``odd``, rows of those that are)."""
    return df.join(odd, by, "left_anti"), df.join(odd, by, "left_semi")


def pages_for_spans(spans: DataFrame, pages: DataFrame, key: str = "document_id") -> DataFrame:
    """``spans`` (key, span_id, start, end) with page_start and page_end: pages that a span overlaps, a page's end included.

    Spans and pages of a document go by in one order: the last page that begins before a span's end, and the first one that ends at its start or later, are its pages, for
    page numbers rise with their offsets. Documents where they don't are joined page by page."""
    known = pages.select(key, "page_number", "page_offset", (F.col("page_offset") + F.col("page_length")).alias("page_until")).dropna()
    asked = spans.select(key, "span_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    following = Window.partitionBy(key).orderBy("page_offset", "page_number")
    falls = (F.lead("page_number").over(following) <= F.col("page_number")) | (F.lead("page_until").over(following) < F.col("page_until"))
    odd = known.withColumn("_odd", falls).filter("_odd").select(key).distinct()
    (asked, odd_asked), (known, odd_known) = _apart(asked, [key], odd), _apart(known, [key], odd)
    none = F.lit(None)

    def swept(spans: DataFrame, at: str, page_at: str, found: Column, name: str) -> DataFrame:
        rows = spans.withColumn("at", F.col(at).cast("long")).withColumn("page_number", none.cast("int"))
        marks = known.select(key, *(none.cast(t).alias(c) for c, t in spans.dtypes if c != key), F.col(page_at).cast("long").alias("at"), F.col("page_number").cast("int").alias("page_number"))
        return rows.unionByName(marks).withColumn(name, found).filter("page_number IS NULL").drop("at", "page_number")

    order = Window.partitionBy(key).orderBy("at", F.col("page_number").isNotNull())  # a span before the pages at its place
    last = swept(asked.filter("_s IS NOT NULL AND _e IS NOT NULL"), "_e", "page_offset", F.max("page_number").over(order.rowsBetween(Window.unboundedPreceding, 0)), "page_end")
    both = swept(last, "_s", "page_until", F.min("page_number").over(order.rowsBetween(0, Window.unboundedFollowing)), "page_start").filter("page_start <= page_end")
    met = odd_asked.join(odd_known, key).filter("page_offset < _e AND page_until >= _s")
    joined = met.groupBy(key, "span_id").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    return both.select(key, "span_id", "page_start", "page_end").unionByName(joined)


#: Kinds of node by the last step of their ids; nodes of one kind follow one another.
STEPS = ("act", "section", "subsection", "paragraph", "subparagraph", "description", "schedule")


def _innermost(spans: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, span_id, o (depth, provision_id, start): the deepest node that holds a span (span_id, _s, _e), of equally deep ones the first id.

    Nodes and spans of a group go by in order of their starts, and of each kind the node that began last is the only one that may still be open. Groups
    where nodes of a kind overlap or have another kind, and spans without length, are joined with all nodes instead. Both are dealt out by group once, together:
    a union of tables that are dealt out apart isn't dealt out itself, as each may have had its partitions merged in its own way."""
    step = F.coalesce(F.nullif(F.regexp_extract("provision_id", "([a-z]+):[^/]*$", 1), F.lit("")), F.lit("?"))
    # Both are read several times, and are narrow: what they are made from is worked out once.
    every = checkpointed(nodes.select(*by, "provision_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna())
    asked = checkpointed(spans.select(*by, "span_id", F.col("_s").cast("long").alias("_s"), F.col("_e").cast("long").alias("_e")).dropna())
    node = F.struct((-path_depth(F.col("provision_id"))).alias("up"), "provision_id", "start", "end")
    opens = every.select(*by, F.col("start").alias("at"), F.col("end").alias("until"), step.alias("step"), node.alias("node"))
    kinds = dict(asked.dtypes)
    rows = opens.select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("span_id", "_s", "_e"))).unionByName(asked.withColumn("at", F.col("_s")), allowMissingColumns=True)
    whole, is_node = Window.partitionBy(*by), F.col("step").isNotNull()
    after = Window.partitionBy(*by, "step").orderBy("at", "until")
    overlaps = (F.lead("at").over(after) < F.col("until")) | (F.lead("at").over(after) == F.col("at"))
    dealt = rows.repartition(*by).withColumn("_odd", is_node & (~F.col("step").isin(*STEPS) | F.coalesce(overlaps, F.lit(False))))
    so_far = whole.orderBy("at", ~is_node).rowsBetween(Window.unboundedPreceding, 0)  # nodes before the spans at their place
    last = [F.last(F.when(F.col("step") == s, F.col("node")), ignorenulls=True).over(so_far).alias(s) for s in STEPS]
    open_ = F.filter(F.array(*STEPS), lambda n: n["end"] >= F.col("_e"))
    swept = dealt.withColumn("_odd", F.max("_odd").over(whole)).select("*", *last).filter("step IS NULL")
    swept = checkpointed(swept.select(*by, "span_id", "_s", "_e", (F.col("_odd") | (F.col("_e") <= F.col("_s"))).alias("_rest"), F.array_min(open_).alias("o")))
    rest = swept.filter("_rest").select(*by, "span_id", "_s", "_e").join(every, by).filter("start <= _s AND end >= _e")
    joined = rest.groupBy(*by, "span_id").agg(F.min(node).alias("o"))
    return swept.filter("NOT _rest AND o IS NOT NULL").select(*by, "span_id", "o").unionByName(joined)


def nested_owner(spans: DataFrame, provisions: DataFrame, key: str = "document_id") -> DataFrame:
    """key, span_id, owner: the deepest node that holds the span; of equally deep ones the first id."""
    asked = spans.select(key, "span_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return _innermost(asked, provisions, [key]).select(key, "span_id", F.col("o.provision_id").alias("owner"))


def reference_targets(candidates: DataFrame, strict: bool = False) -> DataFrame:
    """``candidates`` (source_provision_id, kind, literal) with targets, an array, and reason where there are none. Section references are
    ranges or lists; every run of digits counts, those in brackets too unless ``strict``."""
    act, literal = path_act(F.col("source_provision_id")), F.col("literal")
    other = F.nullif(F.regexp_extract(literal, r"(?i)\[Act\s+([0-9]+)\]", 1), F.lit(""))
    body = F.regexp_extract(literal, r"(?i)^\w+\s+(.*?)(?:\s+of\s+(?:this Act|the .*))?$", 1)
    plain = F.regexp_replace(body, r"\([^)]*\)", "") if strict else body
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"([0-9]{1,3}[A-Za-z]{0,2})"), F.lit(1)), F.upper))
    ranged = F.transform(expand_range(body), lambda n: n.cast("string"))
    of_act = lambda number, ns: F.transform(ns, lambda n: F.concat(F.lit("act:"), number, F.lit("/section:"), n))
    is_range = body.rlike(r"^\s*[0-9]+\s*(?:to|–|-)\s*[0-9]+\s*$")
    section = F.when(other.isNotNull(), of_act(other, numbers)).when(is_range, of_act(act, ranged)).otherwise(of_act(act, numbers))
    own = path_section(F.col("source_provision_id"))
    number = F.regexp_extract(body, r"^\s*\(([0-9]+[A-Za-z]?)\)\s*$", 1)
    absolute = F.concat(F.lit("act:"), act, F.lit("/section:"), F.upper(F.regexp_extract(body, r"^\s*([0-9]{1,3}[A-Za-z]{0,2})\s*\(", 1)), F.lit("/subsection:"), F.upper(F.regexp_extract(body, r"\(([0-9]+[A-Za-z]?)\)\s*$", 1)))
    subsection = F.when(body.rlike(r"^\s*[0-9]{1,3}[A-Za-z]{0,2}\s*\([0-9]+[A-Za-z]?\)\s*$"), F.array(absolute)).when((number != "") & (own != ""), F.array(F.concat(F.lit("act:"), act, F.lit("/section:"), own, F.lit("/subsection:"), number)))
    scope = F.regexp_replace("source_provision_id", "/paragraph:.*$", "")
    letters = F.transform(F.regexp_extract_all(body, F.lit(r"\(([A-Za-z]{1,3})\)"), F.lit(1)), F.lower)
    paragraph = F.when(scope.contains("/subsection:") & (F.size(letters) > 0), F.transform(letters, lambda x: F.concat(scope, F.lit("/paragraph:"), x)))
    par_scope = F.regexp_replace("source_provision_id", "/subparagraph:.*$", "")
    subparagraph = F.when(par_scope.contains("/paragraph:") & (F.size(letters) > 0), F.transform(letters, lambda x: F.concat(par_scope, F.lit("/subparagraph:"), x)))
    named = lambda prefix: F.array(F.concat(F.lit("act:"), act, F.lit(prefix), F.lower(F.regexp_replace(body, r"\s+", ""))))
    kind = F.col("kind")
    targets = (
        F.when((kind == "act") & other.isNotNull(), F.array(F.concat(F.lit("act:"), other)))
        .when(kind == "act", F.array(F.concat(F.lit("act:"), act)))
        .when(kind == "section", section)
        .when(other.isNotNull(), F.lit(None))
        .when(kind == "subsection", subsection)
        .when(kind == "paragraph", paragraph)
        .when(kind == "subparagraph", subparagraph)
        .when(kind == "part", named("/description:part-"))
        .when(kind == "schedule", named("/schedule:"))
    )
    none = F.size(F.coalesce(F.col("targets"), F.array().cast("array<string>"))) == 0
    reason = F.when(none & (kind != "section") & other.isNotNull(), "cross_act_non_section").when(none & (kind == "section"), F.when(is_range, "malformed_range").otherwise("malformed_reference")).when(none, "relative_context_missing")
    return candidates.withColumn("targets", targets).withColumn("reason", reason).withColumn("cross_act", other.isNotNull())


def resolve_references(candidates: DataFrame, provisions: DataFrame) -> DataFrame:
    """``candidates`` (candidate_id, targets, reason, cross_act) with resolved and reason: all targets inside the act must be indexed, or none counts."""
    each = candidates.filter("targets IS NOT NULL AND size(targets) > 0").select("candidate_id", "cross_act", F.explode("targets").alias("provision_id"))
    known = provisions.select("provision_id").distinct().withColumn("known", F.lit(True))
    judged = each.join(known, "provision_id", "left").groupBy("candidate_id").agg(F.bool_and(F.col("cross_act") | F.coalesce("known", F.lit(False))).alias("all_known"))
    out = candidates.join(judged, "candidate_id", "left")
    fine = F.coalesce("all_known", F.lit(False))
    return out.withColumn("resolved", fine).withColumn("reason", F.when(fine, F.lit(None)).otherwise(F.coalesce("reason", F.lit("target_not_indexed")))).drop("all_known")


def _candidates(provisions: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Every reference in ``texts`` (key, part, text) with the deepest node that holds it: key, part, source_provision_id, kind, literal, first, last (in the text),
    start_offset, end_offset (in the node), candidate_id, targets, resolved, reason, cross_act."""
    refs = _references(texts.select(key, "part", "text"), [key, "part"]).withColumnsRenamed({"start_offset": "first", "end_offset": "last"})
    span = F.concat_ws(":", "part", "first", "last").alias("span_id")
    spans = refs.select(key, "part", span, F.col("first").alias("start"), F.col("last").alias("end")).distinct()
    local = lambda c: F.concat_ws("#", F.col(key).cast("string"), c)  # noqa: E731  provision ids name the act; two documents of one act are kept apart
    held = _innermost(spans.select(key, "part", "span_id", F.col("start").alias("_s"), F.col("end").alias("_e")), provisions, [key, "part"])
    owners = held.select(key, "span_id", F.col("o.provision_id").alias("source_provision_id"), F.col("o.start").alias("_from"))
    owned = refs.withColumn("span_id", span).join(owners, [key, "span_id"])
    owned = owned.withColumn("start_offset", F.col("first") - F.col("_from")).withColumn("end_offset", F.col("last") - F.col("_from")).drop("_from", "span_id")
    named = owned.withColumn("candidate_id", candidate_id(F.col("source_provision_id"), F.col("start_offset"), F.col("literal")))
    aimed = reference_targets(named).withColumnRenamed("candidate_id", "own_id").withColumn("candidate_id", local(F.col("own_id")))
    apart = F.transform("targets", lambda t: F.when(F.col("cross_act") | ~t.contains("/"), t).otherwise(local(t)))
    known = provisions.select(local(F.col("provision_id")).alias("provision_id"))
    judged = resolve_references(aimed.withColumn("targets", apart).withColumn("cross_act", F.col("cross_act") | (F.col("kind") == "act")), known)
    plain = F.transform("targets", lambda t: F.regexp_replace(t, "^[^#]*#", ""))
    return judged.drop("candidate_id").withColumnRenamed("own_id", "candidate_id").withColumn("targets", plain)


def build_graph(texts: DataFrame, key: str = "document_id", act: str = "act_number", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(provisions, edges, unresolved) of a table of whole texts, each document by itself, without pages."""
    provisions = parse_provisions(texts, key, act, text).withColumn("part", F.lit("main"))
    judged = _candidates(provisions, texts.select(key, F.lit("main").alias("part"), F.col(text).alias("text")), key)
    fields = [key, "source_provision_id", "literal", F.col("kind").alias("reference_kind"), "start_offset", "end_offset"]
    edges = judged.filter("resolved").select(*fields, F.explode("targets").alias("target_provision_id")).withColumn("relationship", F.lit("explicit_reference"))
    edges = edges.withColumn("edge_id", edge_id(F.col("source_provision_id"), F.col("target_provision_id"), F.col("start_offset"), F.col("literal"))).dropDuplicates([key, "edge_id"])
    return provisions.drop("part"), edges, judged.filter("NOT resolved").select(*fields, "reason")


def graph_of_pages(pages: DataFrame, documents: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(provisions, edges, unresolved, candidates) of documents given by their pages (``provision_tree``). Edges and candidates carry the version ids of their ends
    (null for targets of other acts) and evidence: the literal, its offsets in the source node, and the pages that it stands on."""
    texts, offsets = _parts(pages, documents, key)
    provisions = checkpointed(_tree(texts, offsets, documents, key))
    judged = checkpointed(_candidates(provisions.filter("part <> 'title'"), texts, key))  # for their pages, and to be met with them
    spans = judged.select(key, "part", F.col("first").alias("start"), F.col("last").alias("end"))
    on = _page_range(spans, offsets, [key, "part"]).select(key, "part", F.col("start").alias("first"), F.col("end").alias("last"), F.sequence("page_start", "page_end").alias("_pages"))
    version = lambda c: F.concat(F.col(key), F.lit("/provision:"), c)
    evidence = F.struct(F.col("literal").alias("text"), "start_offset", "end_offset", F.transform("_pages", lambda p: F.struct(p.alias("page_number"))).alias("pages"))
    seen = judged.join(on, [key, "part", "first", "last"], "left").withColumn("evidence", evidence).withColumn("source_version_id", version(F.col("source_provision_id")))
    seen = checkpointed(seen.select(key, "candidate_id", "source_provision_id", "source_version_id", "literal", "kind", "targets", "resolved", "reason", "evidence"))
    fine = F.coalesce("targets", F.array().cast("array<string>"))
    candidates = seen.select(key, "candidate_id", "source_provision_id", "source_version_id", "literal", F.col("kind").alias("reference_kind"), F.when(F.col("resolved"), fine).otherwise(F.array().cast("array<string>")).alias("target_provision_ids"), F.when(F.col("resolved"), "resolved").otherwise("unresolved").alias("resolution"), F.col("reason").alias("reason_code"), "evidence")
    start = F.col("evidence.start_offset")
    edges = seen.filter("resolved").select(key, "source_provision_id", "source_version_id", "literal", F.col("kind").alias("reference_kind"), start.alias("start_offset"), F.col("evidence.end_offset").alias("end_offset"), "evidence", F.explode("targets").alias("target_provision_id"))
    known = provisions.select(key, F.col("provision_id").alias("target_provision_id"), F.col("version_id").alias("target_version_id"))
    edges = edges.join(known, [key, "target_provision_id"], "left").withColumn("relationship", F.lit("explicit_reference"))
    edges = edges.withColumn("edge_id", edge_id(F.col("source_provision_id"), F.col("target_provision_id"), F.col("start_offset"), F.col("literal"))).dropDuplicates([key, "edge_id"])
    unresolved = candidates.filter("resolution = 'unresolved'").drop("target_provision_ids", "resolution").withColumn("reason", F.col("reason_code"))
    return _with_text(provisions, texts, documents, key), edges, unresolved, candidates


def logical_keys(edges: DataFrame) -> DataFrame:
    """``edges`` with wording that doesn't depend on the document: literal_wording, reference_kind and relationship normalised."""
    return edges.withColumns({"literal_wording": normalize_wording(F.col("literal")), "reference_kind": normalize_wording(F.col("reference_kind")), "relationship": normalize_wording(F.col("relationship"))})


def compare_snapshots(base: DataFrame, compare: DataFrame) -> DataFrame:
    """Logical key, ordinal and status (unchanged, removed, added) of the union of two multisets of edges; the n-th occurrence of a key meets the n-th."""
    side = lambda df, name: with_ordinal(logical_keys(df), LOGICAL, ["page_number", "start_offset", "end_offset", "edge_id"]).select(*LOGICAL, "ordinal", F.col("edge_id").alias(name))
    met = side(base, "base_edge").join(side(compare, "compare_edge"), [*LOGICAL, "ordinal"], "full_outer")
    status = F.when(F.col("base_edge").isNull(), "added").when(F.col("compare_edge").isNull(), "removed").otherwise("unchanged")
    return met.withColumn("status", status)


def union_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    met = a.select("provision_id", F.lit(True).alias("_a")).distinct().join(b.select("provision_id", F.lit(True).alias("_b")).distinct(), "provision_id", "full_outer")
    return met.select("provision_id", F.when(F.col("_b").isNull(), "base").when(F.col("_a").isNull(), "compare").otherwise("both").alias("presence"))


def compare_status(pairs: DataFrame, documents: DataFrame, provisions: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, base_id, compare_id, focus) with status: what keeps two snapshots from being compared, or available."""
    docs = documents.select("document_id", "act_number", "language", "indexed")
    base, comp = (docs.select(F.col("document_id").alias(i), *(F.col(c).alias(f"{s}_{c}") for c in ("act_number", "language", "indexed"))) for i, s in (("base_id", "b"), ("compare_id", "c")))
    nodes = provisions.select("document_id", "provision_id").distinct()
    seen = lambda i, s: nodes.select(F.col("document_id").alias(i), F.col("provision_id").alias("focus"), F.lit(True).alias(s))
    met = pairs.join(base, "base_id", "left").join(comp, "compare_id", "left").join(seen("base_id", "b_focus"), ["base_id", "focus"], "left").join(seen("compare_id", "c_focus"), ["compare_id", "focus"], "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    status = (
        F.when(no("b_indexed"), "base_not_indexed")
        .when(no("c_indexed"), "compare_not_indexed")
        .when(F.col("b_act_number") != F.col("c_act_number"), "different_act")
        .when(F.col("b_language") != F.col("c_language"), "different_language")
        .when(no("b_focus"), "focus_missing_in_base")
        .when(no("c_focus"), "focus_missing_in_compare")
        .otherwise("available")
    )
    return met.select(*pairs.columns, status.alias("status"))


def promote(edges: DataFrame, unresolved: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): approved edges stay; rejected ones become one unresolved row each. Undecided edges stay out."""
    at = ["source_provision_id", "literal", "start_offset"]
    kept = edges.join(audit.filter("decision = 'approved'").select(*at).distinct(), at, "left_semi")
    out = edges.join(audit.filter("decision = 'rejected'").select(*at).distinct(), at, "left_semi").select(*at).distinct().withColumn("reason", F.lit("audit_rejected"))
    return kept, unresolved.select(*at, "reason").unionByName(out)


def audit_report(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("candidates"), F.count_if(F.coalesce("decision", F.lit("pending")) == "pending").alias("pending")).withColumn("gate_required", F.col("pending") > 0)


def decision_form(candidates: DataFrame) -> DataFrame:
    """document_id, candidate_id, decision, audit_note, review_context: a blank form for each candidate, with what a reviewer has to see. Decisions and notes are
    empty, whatever the candidates have: none is made beforehand."""
    seen = [c for c in ("source_provision_id", "literal", "resolution", "reason_code", "target_provision_ids", "evidence") if c in candidates.columns]
    return candidates.select("document_id", "candidate_id", F.lit("").alias("decision"), F.lit("").alias("audit_note"), F.struct(*seen).alias("review_context"))


def unique_identity(df: DataFrame, keys: list[str], identity: tuple[str, str] = ("document_id", "extraction_id"), order: str = "chunk_ordinal") -> DataFrame:
    """The first row of each key whose rows all have one and the same identity; other keys give none."""
    same = F.struct(*identity)
    one = df.groupBy(*keys).agg(F.count_distinct(F.to_json(same, {"ignoreNullFields": "false"})).alias("_k"), F.min_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row"))
    return one.filter("_k = 1").select(*keys, "_row.*")


def follow_references(anchors: DataFrame, edges: DataFrame, targets: DataFrame, direction: str = "outgoing", max_edges: int = MOST_EDGES) -> DataFrame:
    """Edges of each anchor section and what lies below it, at most ``max_edges`` (5 at most) by a fixed order, with the section at the other end: anchor_id, n, edge_id,
    target_section, document_id, extraction_id, cross_act, found. A target of the anchor's own act must be of its document and extraction."""
    near, far = ("source_provision_id", "target_provision_id") if direction == "outgoing" else ("target_provision_id", "source_provision_id")
    section_of = F.regexp_extract(near, r"^(act:[^/]+/section:[^/]+)", 1)
    anchored = anchors.select("anchor_id", F.col("provision_id").alias("root"), F.col("document_id").alias("a_doc"), F.col("extraction_id").alias("a_run"), F.regexp_extract("provision_id", r"^(act:[^/]+/section:[^/]+)", 1).alias("section"))
    met = edges.withColumn("section", section_of).join(anchored, "section").filter(in_scope(F.col(near), F.col("root")) & ((F.col("document_id") == F.col("a_doc"))))
    order = Window.partitionBy("anchor_id").orderBy("reference_kind", "source_provision_id", "target_provision_id", "start_offset", "literal", "edge_id")
    cut = met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(0, min(max_edges, MOST_EDGES)))
    act, number = path_act(F.col(far)), path_section(F.col(far))
    aimed = cut.select("anchor_id", "n", "edge_id", "a_doc", "a_run", F.regexp_extract(far, r"^(act:[^/]+(?:/section:[^/]+)?)", 1).alias("target_section"), act.alias("t_act"), number.alias("t_number"), (act != path_act(F.col("root"))).alias("cross_act"))
    rows = targets.select(F.col("act_number").alias("t_act"), F.col("section_number").alias("t_number"), "document_id", "extraction_id")
    looked = aimed.join(rows, ["t_act", "t_number"], "left").filter("document_id IS NULL OR cross_act OR (document_id = a_doc AND extraction_id = a_run)")
    one = looked.groupBy("anchor_id", "n").agg(F.count_distinct("document_id", "extraction_id").alias("k"), F.min("document_id").alias("document_id"), F.min("extraction_id").alias("extraction_id"))
    out = aimed.join(one, ["anchor_id", "n"], "left")
    fine = F.coalesce(F.col("k") == 1, F.lit(False))
    return out.select("anchor_id", "n", "edge_id", "target_section", F.when(fine, F.col("document_id")).alias("document_id"), F.when(fine, F.col("extraction_id")).alias("extraction_id"), "cross_act", fine.alias("found"))


def follow_metrics(followed: DataFrame) -> DataFrame:
    """Counters of a follow, by anchor; ``merge_metrics`` adds them up."""
    return followed.groupBy("anchor_id").agg(F.count("*").alias("edges_returned"), F.count_if("found").alias("targets_resolved"), F.count_if(~F.col("found")).alias("targets_failed"), F.count_if("cross_act").alias("cross_act_targets"))


def merge_metrics(df: DataFrame) -> DataFrame:
    """name, total over a table of counters."""
    names = [c for c, t in df.dtypes if t in ("int", "bigint")]
    return df.unpivot([], names, "name", "value").groupBy("name").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


def followed_tags(followed: DataFrame) -> DataFrame:
    """target_section, scope and the sorted directions in which it was reached."""
    return followed.filter("found").groupBy("target_section").agg(F.array_sort(F.collect_set("direction")).alias("directions"), F.when(F.bool_or("cross_act"), "cross_act").otherwise("same_act").alias("scope"))


def neighborhood(edges: DataFrame, provisions: DataFrame, focus: DataFrame, direction: str = "both", include_descendants: bool = True) -> DataFrame:
    """focus_id, edge_id, direction, other, boundary: edges that leave or reach each focus node (and what is below it); a node at the far end that isn't among ``provisions`` is a boundary."""
    sides = {"out": ("source_provision_id", "target_provision_id"), "in": ("target_provision_id", "source_provision_id")}
    wanted = sides if direction == "both" else {direction: sides[direction]}
    parts = []
    for name, (near, far) in wanted.items():
        head = F.regexp_extract(near, r"^(act:[^/]+(?:/[^/]+)?)", 1)
        roots = focus.select("focus_id", F.col("provision_id").alias("root"), F.regexp_extract("provision_id", r"^(act:[^/]+(?:/[^/]+)?)", 1).alias("head"))
        hit = in_scope(F.col(near), F.col("root")) if include_descendants else F.col(near) == F.col("root")
        parts.append(edges.withColumn("head", head).join(roots, "head").filter(hit).select("focus_id", "edge_id", F.lit(name).alias("direction"), F.col(far).alias("other")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    local = provisions.select(F.col("provision_id").alias("other"), F.lit(True).alias("_here")).distinct()
    return both.join(local, "other", "left").select("focus_id", "edge_id", "direction", "other", F.col("_here").isNull().alias("boundary"))
