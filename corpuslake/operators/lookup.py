"""Which chunks are visible, exact and semantic lookup, and checks of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.keys import canonical_act, canonical_section, deep_link
from corpuslake.operators.vectors import nearest
from corpuslake.sources.scratch import checkpointed

MAPPING = ["act_number", "language", "document_id", "extraction_id"]


def visible_chunks(chunks: DataFrame, active: DataFrame, mode: str = "dual") -> DataFrame:
    """``legacy``: rows without provenance; ``verified``: rows that the active mapping names; ``dual``: these,
    and legacy rows of acts and languages that have no mapping."""
    legacy = chunks.filter("document_id IS NULL")
    if mode == "legacy":
        return legacy
    verified = chunks.join(active.select(*MAPPING), MAPPING, "left_semi")
    if mode == "verified":
        return verified
    if mode != "dual":
        raise ValueError(f"unknown mode {mode!r}")
    owned = active.select("act_number", "language").distinct()
    return verified.unionByName(legacy.join(owned, ["act_number", "language"], "left_anti"))


def filter_chunks(df: DataFrame, act_number: str | None = None, language: str | None = None) -> DataFrame:
    if act_number:
        df = df.filter(F.col("act_number") == act_number)
    return df.filter(F.col("language") == language) if language else df


def with_provenance(chunks: DataFrame, active: DataFrame, docs: DataFrame) -> DataFrame:
    """``chunks`` with is_active and the registered document's source_url."""
    marked = active.select(*MAPPING).distinct().withColumn("is_active", F.lit(True))
    out = chunks.join(marked, MAPPING, "left").join(docs.select("document_id", "source_url"), "document_id", "left")
    return out.withColumn("is_active", F.coalesce("is_active", F.lit(False)))


def with_pdf_url(chunks: DataFrame, reprints: DataFrame) -> DataFrame:
    """``chunks`` with pdf_url; ``reprints``: act_number, reprint_url (one row an act)."""
    link = deep_link(F.when(F.col("document_id").isNotNull(), F.col("source_url")), F.col("reprint_url"), F.col("page_start"))
    return chunks.join(reprints.select("act_number", "reprint_url"), "act_number", "left").withColumn("pdf_url", link).drop("reprint_url")


def with_title(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """``docs`` with act_title in their own language, empty if there is none."""
    own = F.when(F.col("language") == "bm", F.col("title_bm")).otherwise(F.col("title_en"))
    return docs.join(titles.select("act_number", "title_en", "title_bm"), "act_number", "left").withColumn("act_title", F.coalesce(own, F.lit(""))).drop("title_en", "title_bm")


def title_map(index: DataFrame) -> DataFrame:
    """act_number, title_en, title_bm: the first title of each language that isn't empty, by ``pos``."""
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.trim(c)), F.when(F.col(c) != "", F.col("pos"))), F.lit("")).alias(c)
    return index.filter("act_number <> ''").groupBy("act_number").agg(first("title_en"), first("title_bm"))


#: Characters that names and titles meet by.
NAME_SEED = 6


def titles_holding(titles: DataFrame, names: DataFrame, seed: int = NAME_SEED) -> DataFrame:
    """_name, of_title: the titles (act_title) that hold a lower-case name anywhere.

    Names and titles, each once, meet by runs of ``seed`` characters (all of a shorter name): of a name's runs by the one that the fewest titles have, and a name with a
    run that no title has is in none. So names that begin like most titles, as "act ", meet few of them."""
    asked = names.filter("_name <> ''").withColumn("width", F.least(F.length("_name"), F.lit(seed)))
    runs = lambda text, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)))
    grams = asked.select("_name", "width", F.explode(runs(F.col("_name"), F.col("width"))).alias("gram"))
    low = F.lower("act_title")
    widths = F.broadcast(asked.select("width").distinct())  # 1 to ``seed``
    cut = titles.filter("act_title IS NOT NULL").join(widths, F.length(low) >= F.col("width")).select("act_title", "width", F.explode(runs(low, F.col("width"))).alias("gram"))
    held = checkpointed(cut.join(grams.select("width", "gram").distinct(), ["width", "gram"], "left_semi"))
    often = held.groupBy("width", "gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")
    best = grams.join(often, ["width", "gram"], "left").groupBy("_name", "width").agg(rarest).filter("r.n > 0").select("_name", "width", "r.gram")
    met = held.join(best, ["width", "gram"]).filter(low.contains(F.col("_name")))
    return met.select("_name", F.col("act_title").alias("of_title"))


def exact_lookup(chunks: DataFrame, requests: DataFrame, limit: int = 3) -> DataFrame:
    """request_id, rank and the chunk's columns, for requests with request_id, section and act_number or act_title (and both or
    neither of want_document, want_extraction). The act's own number goes before titles that hold the name, English
    before others, then document and ordinal."""
    asked = requests.filter((F.coalesce("section", F.lit("")) != "") & (F.col("act_number").isNotNull() | F.col("act_title").isNotNull()) & (F.col("want_document").isNull() == F.col("want_extraction").isNull()))
    asked = asked.select("request_id", F.upper("section").alias("want_section"), F.col("act_number").alias("want_act"), F.col("act_title").alias("want_title"), "want_document", "want_extraction")
    keyed = chunks.withColumn("want_section", F.upper("section_number"))
    # Two equi-joins instead of one with OR: by number, and for requests that name a title by the titles that hold it.
    by_act = keyed.join(asked, (keyed.want_section == asked.want_section) & (keyed.act_number == asked.want_act)).drop(asked.want_section)
    titled = asked.filter(F.coalesce("want_title", F.lit("")) != "").withColumn("_name", F.lower("want_title"))
    held = titles_holding(chunks.select("act_title").distinct(), titled.select("_name").distinct())
    meant = titled.join(held, "_name").drop("_name")
    # A request takes ``limit`` rows at most, and leaves out one act's: so twice as many of a title's section, of which each act has no more than its own best, are enough.
    best = [F.when(F.col("language") == "en", 0).otherwise(1), "act_number", "language", "document_id", "chunk_ordinal"]
    own = F.row_number().over(Window.partitionBy("act_title", "want_section", "act_number").orderBy(*best))
    of_acts = keyed.withColumn("_r", own).filter(F.col("_r") <= limit)
    few = of_acts.withColumn("_r", F.row_number().over(Window.partitionBy("act_title", "want_section").orderBy(*best))).filter(F.col("_r") <= 2 * limit).drop("_r")
    named = lambda rows, more: rows.join(more, (rows.want_section == more.want_section) & (rows.act_title == more.of_title) & ~F.coalesce(rows.act_number == more.want_act, F.lit(False)))
    free, fixed = meant.filter("want_document IS NULL"), meant.filter("want_document IS NOT NULL")
    by_title = named(few, free).drop(free.want_section, free.of_title)
    of_document = named(keyed, fixed).filter("document_id = want_document AND extraction_id = want_extraction").drop(fixed.want_section, fixed.of_title)
    by_title = by_title.unionByName(of_document)
    met = by_act.unionByName(by_title).filter("want_document IS NULL OR (document_id = want_document AND extraction_id = want_extraction)")
    order = Window.partitionBy("request_id").orderBy(F.when(F.col("act_number") == F.col("want_act"), 0).otherwise(1), F.when(F.col("language") == "en", 0).otherwise(1), "act_number", "language", "document_id", "chunk_ordinal")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("want_section", "want_act", "want_title", "want_document", "want_extraction")


def semantic_search(items: DataFrame, queries: DataFrame, k: int = 8, key: str = "vec_id") -> DataFrame:
    """query_id, rank, key, similarity: the k items most like each query (query_id, query_vec) by cosine, exactly."""
    return nearest(items, queries, k, key)


def retrieve(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """Exact hits, and semantic ones of requests that have none."""
    rest = semantic.join(exact.select("request_id").distinct(), "request_id", "left_anti")
    return exact.withColumn("via", F.lit("exact")).unionByName(rest.withColumn("via", F.lit("semantic")), allowMissingColumns=True)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("act_key", canonical_act(F.col("act_number"))).withColumn("section_key", canonical_section(F.col("section_number")))


def missing_sections(required: DataFrame, present: DataFrame) -> DataFrame:
    """act_number, section_number (canonical) that are required and not present."""
    pairs = lambda df: _keyed(df).filter("act_key <> '' AND section_key <> ''").select(F.col("act_key").alias("act_number"), F.col("section_key").alias("section_number")).distinct()
    return pairs(required).join(pairs(present), ["act_number", "section_number"], "left_anti")


def citations_not_in_corpus(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """The usable citations (canonical key) that no chunk has."""
    have = _keyed(chunks).select("act_key", "section_key").distinct()
    return _keyed(citations).filter("act_key <> '' AND section_key <> ''").join(have, ["act_key", "section_key"], "left_anti")


def validate_citations(turns: DataFrame, citations: DataFrame, retrieved: DataFrame, acts: DataFrame) -> DataFrame:
    """turn_id, violations: one array for each turn: none cited, unknown act, or not among what the turn retrieved."""
    cited = _keyed(citations).filter("NOT (act_key = '' AND section_key = '')").select("turn_id", "act_key", "section_key").distinct()
    known = acts.select(F.col("act_number").alias("act_key")).distinct().withColumn("known", F.lit(True))
    seen = _keyed(retrieved).select("turn_id", "act_key", "section_key").distinct().withColumn("seen", F.lit(True))
    met = cited.join(known, "act_key", "left").join(seen, ["turn_id", "act_key", "section_key"], "left")
    # The wording of the messages.
    unknown = F.when(F.col("known").isNull(), F.concat(F.lit("Citation references unknown Act "), "act_key", F.lit(".")))
    unseen = F.when(F.col("seen").isNull(), F.concat(F.lit("Citation Section "), "section_key", F.lit(" of Act "), "act_key", F.lit(" was not in retrieved sources.")))
    listed = met.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("act_key", "section_key", F.array_compact(F.array(unknown, unseen)).alias("said")))).alias("said"))
    none = F.array(F.lit("No citation found. A legal answer must cite at least one retrieved section."))
    return turns.select("turn_id").join(listed, "turn_id", "left").select("turn_id", F.when(F.col("said").isNull(), none).otherwise(F.flatten(F.col("said.said"))).alias("violations"))


def attach_citations(refs: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Each reference with the first retrieved chunk, by rank, that has its key."""
    first = _keyed(retrieved).withColumn("_n", F.row_number().over(Window.partitionBy("turn_id", "act_key", "section_key").orderBy("rank"))).filter("_n = 1").select("turn_id", "act_key", "section_key", "rank", "chunk_id")
    return _keyed(refs).drop("act_number", "section_number").join(first, ["turn_id", "act_key", "section_key"])


def resolve_alias(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` with document_id replaced by what its alias stands for."""
    named = aliases.select(F.col("alias").alias("document_id"), F.col("target").alias("_target"))
    return df.join(named, "document_id", "left").withColumn("document_id", F.coalesce("_target", "document_id")).drop("_target")


def select_run(requests: DataFrame, runs: DataFrame, active: DataFrame) -> DataFrame:
    """request_id, document_id, extraction_id, error: the requested run if it is ready and the document's own; the active one if none is asked for."""
    ready = runs.filter("status = 'ready'").select("document_id", F.col("extraction_id").alias("asked"), F.lit(True).alias("fine"))
    now = active.select("document_id", F.col("extraction_id").alias("current")).distinct()
    met = requests.select("request_id", "document_id", F.col("extraction_id").alias("asked")).join(ready, ["document_id", "asked"], "left").join(now, "document_id", "left")
    chosen = F.when(F.col("asked").isNull(), F.col("current")).when(F.col("fine"), F.col("asked"))
    return met.select("request_id", "document_id", chosen.alias("extraction_id"), F.when(chosen.isNull(), F.when(F.col("asked").isNull(), "no_active_extraction").otherwise("extraction_not_ready")).alias("error"))


def seed_sections(required: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that a set of cases needs."""
    need = _keyed(required).filter("act_key <> '' AND section_key <> ''").select("act_key", "section_key").distinct()
    return _keyed(chunks).join(need, ["act_key", "section_key"], "left_semi").drop("act_key", "section_key")

