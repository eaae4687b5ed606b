"""Finding quoted passages: a table of quotes against a table of texts, and their place on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.udfs import folded_text, nearest_places, nfkc_casefold
from corpuslake.functions.values import tokens
from corpuslake.sources.scratch import checkpointed

SEED_TOKENS = 8


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens (array) of the text in NFKC with cases folded, so that ligatures, full-width forms and sharp s meet their plain spellings."""
    folded = nfkc_casefold(df.select(key, text), text, "_folded")
    return folded.select(key, tokens(F.col("_folded")).alias("tokens"))


def seeds(quotes: DataFrame, docs: DataFrame, seed: int = SEED_TOKENS) -> DataFrame:
    """doc_id, position, quote_id, length: where a quote may begin.

    A text's runs of ``seed`` tokens (of all of a quote's, if they are fewer) are hashed, and those that any quote has are kept and counted. A quote is looked for by
    the rarest of its runs alone, and one with a run that no text has (its own text, if it names one) is nowhere. So an opening that
    all texts share brings no rows, unless a quote is nothing else."""
    own = ["doc_id"] if "doc_id" in quotes.columns else []
    width = F.least(F.size("tokens"), F.lit(seed)).alias("width")
    hashes = lambda: F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("width") + 1), lambda i: F.xxhash64(F.array_join(F.slice("tokens", i, F.col("width")), " ")))
    asked = quotes.filter("size(tokens) > 0").select("quote_id", *own, F.size("tokens").alias("length"), width, "tokens")
    grams = asked.select("quote_id", *own, "length", "width", F.posexplode(hashes()).alias("offset", "h"))
    widths = F.broadcast(asked.select("width").distinct())  # 1 to ``seed``
    runs = docs.filter("size(tokens) > 0").join(widths, F.size("tokens") >= F.col("width")).select("doc_id", "width", F.posexplode(hashes()).alias("position", "h"))
    key = ["h", "width", *own]
    held = checkpointed(runs.join(grams.select(*key).distinct(), key, "left_semi"))
    often = held.groupBy(*key).agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("r")
    best = grams.join(often, key, "left").groupBy("quote_id", *own, "length", "width").agg(rarest).filter("r.n > 0").select("quote_id", *own, "length", "width", "r.offset", "r.h")
    return held.join(best, key).select("doc_id", (F.col("position") - F.col("offset")).alias("position"), "quote_id", "length").filter("position >= 0")


def phrase_matches(quotes: DataFrame, docs: DataFrame, seed: int = SEED_TOKENS) -> DataFrame:
    """quote_id, doc_id, position of every place where all of a quote's tokens stand in a row. Inputs: quote_id, tokens and doc_id, tokens; where
    ``quotes`` has a doc_id too, a quote is looked for in that text alone.

    ``seeds`` are narrow rows, which the texts' tokens don't travel with; those of a text then meet its tokens once, and only the piece
    that is in question goes on to be compared with the quote."""
    places = seeds(quotes, docs, seed).groupBy("doc_id").agg(F.collect_list(F.struct("quote_id", "length", "position")).alias("places"))
    pieces = docs.select("doc_id", "tokens").join(places, "doc_id").select("doc_id", "tokens", F.explode("places").alias("at"))
    pieces = pieces.select("doc_id", "at.quote_id", "at.position", F.slice("tokens", F.col("at.position") + 1, F.col("at.length")).alias("piece"))
    wanted = quotes.select("quote_id", F.col("tokens").alias("wanted"))
    return pieces.join(wanted, "quote_id").filter("piece = wanted").select("quote_id", "doc_id", "position")


def page_tokens(words: DataFrame, key: str = "doc_id", folded: bool = True) -> DataFrame:
    """key, position, token, first and last word number: the words of a document in order; a word that ends a line with a hyphen is joined with the next one.
    Spellings are folded as in ``token_table``, or else lower-cased alone."""
    along = Window.partitionBy(key).orderBy("page", "n")
    changes = (F.lead("page").over(along) != F.col("page")) | (F.lead("block").over(along) != F.col("block")) | (F.lead("line").over(along) != F.col("line"))
    near = words.withColumn("_next", F.lead("raw").over(along)).withColumn("_joins", F.col("raw").endswith("-") & F.coalesce(changes, F.lit(False)))
    near = near.withColumn("_joined", F.coalesce(F.lag("_joins").over(along), F.lit(False))).filter("NOT _joined")
    text = F.when(F.col("_joins"), F.concat(F.expr("left(raw, length(raw) - 1)"), F.col("_next"))).otherwise(F.col("raw"))
    spelt = near.select(key, "page", "n", F.col("_joins").alias("two"), text.alias("_text"))
    spelt = nfkc_casefold(spelt, "_text", "_folded") if folded else spelt.withColumnRenamed("_text", "_folded")
    each = spelt.select(key, "page", "n", "two", F.posexplode(tokens(F.col("_folded"))).alias("at", "token"))
    return each.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("page", "n", "at")) - 1)


def word_lists(words: DataFrame, key: str = "doc_id", folded: bool = True) -> DataFrame:
    """key, words, tokens: a document's words in order, and its tokens as in ``page_tokens``, each with its page, ``at`` (the place of its word in ``words``) and ``two``
    (it goes on in the next word). Words are dealt out by document once."""
    listed = words.repartition(key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "n", "block", "line", "raw", "x0", "y0", "x1", "y1"))).alias("words"))
    # Arrays are met side by side: a column that a lambda looks up by place may be worked out again for every element.
    changes = lambda w, x: (x["page"] != w["page"]) | (x["block"] != w["block"]) | (x["line"] != w["line"])
    two = lambda w, x: F.coalesce(w["raw"].endswith("-") & changes(w, x), F.lit(False))
    spelt = lambda w, x: F.when(two(w, x), F.concat(F.substr(w["raw"], F.lit(1), F.length(w["raw"]) - 1), x["raw"])).otherwise(w["raw"])
    after = F.concat(F.slice("words", 2, F.size("words")), F.array(F.lit(None)))
    each = F.zip_with("words", after, lambda w, x: F.struct(w["page"].alias("page"), two(w, x).alias("two"), F.replace(F.coalesce(spelt(w, x), F.lit("")), F.lit("\n"), F.lit(" ")).alias("text")))
    placed = listed.withColumn("_each", each).withColumn("_goes_on", F.concat(F.array(F.lit(False)), F.slice("_each.two", 1, F.size("_each") - 1)))
    kept = F.filter(F.transform(F.arrays_zip("_each", "_goes_on"), lambda z, i: F.struct(z["_each"]["page"].alias("page"), i.alias("at"), z["_each"]["two"].alias("two"), z["_each"]["text"].alias("text"), z["_goes_on"].alias("goes_on"))), lambda w: ~w["goes_on"])
    lined = placed.select(key, "words", kept.alias("_kept")).withColumn("_text", F.array_join("_kept.text", "\n"))
    # One column, not a union of folded and other rows: those are dealt out by document already.
    spelt_so = F.split(folded_text(F.col("_text")) if folded else F.col("_text"), "\n", -1)
    each = F.zip_with("_kept", spelt_so, lambda w, text: F.transform(tokens(text), lambda t: F.struct(w["page"].alias("page"), w["at"].alias("at"), w["two"].alias("two"), t.alias("token"))))
    return lined.select(key, "words", F.flatten(each).alias("tokens"))


def locate(quotes: DataFrame, words: DataFrame, pages: DataFrame, folded: bool = True) -> DataFrame:
    """quote_id, doc_id, status (matched, ambiguous, not_found), page, rectangles: where a quote stands in its document from start_page on. Only matches
    on the nearest page count; more than one there are ambiguous. ``quotes``: quote_id, doc_id, start_page, tokens (``folded``: as in ``token_table``).

    Quotes, words and pages meet by document, each dealt out once; after that only the boxes of lines are."""
    sizes = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", F.struct("width", "height")))).alias("sizes"))
    asked = quotes.groupBy("doc_id").agg(F.collect_list(F.struct("quote_id", "start_page", "tokens")).alias("quotes"))
    met = asked.join(word_lists(words, folded=folded), "doc_id", "left").join(sizes, "doc_id", "left")
    found = met.withColumn("found", nearest_places(F.col("tokens.token"), F.col("tokens.page"), F.col("quotes.tokens"), F.col("quotes.start_page")))
    boxed = lambda w: F.struct(*(w[c].alias(c) for c in ("page", "block", "line", "x0", "y0", "x1", "y1")), F.try_element_at("sizes", w["page"]).alias("size"))
    word = lambda i: boxed(F.get("words", i))
    of_token = lambda t: F.when(t["two"], F.array(word(t["at"]), word(t["at"] + 1))).otherwise(F.array(word(t["at"])))
    under = lambda q, f: F.flatten(F.transform(F.slice("tokens", f["position"] + 1, F.size(q["tokens"])), of_token))
    each = F.transform("quotes", lambda q, i: F.struct(q["quote_id"].alias("quote_id"), F.get("found", i)["places"].alias("places"), F.get("found", i)["page"].alias("page"), F.when(F.get("found", i)["places"] == 1, under(q, F.get("found", i))).alias("words")))
    rows = found.select("doc_id", F.explode(each).alias("q")).select("doc_id", "q.quote_id", "q.places", F.col("q.page").alias("on"), F.explode_outer("q.words").alias("w"))
    key = ["doc_id", "quote_id", "places", "on"]
    boxes = _boxes(rows.select(*key, "w.*").withColumns({"w": F.col("size.width"), "h": F.col("size.height")}), [*key, "w", "h"])
    shown = F.when(F.col("w").isNotNull(), F.struct("page", "block", "line", *(c.alias(n) for n, c in _shares().items())))
    listed = boxes.groupBy(*key).agg(F.array_sort(F.collect_list(shown)).alias("rectangles"))
    status = F.when(F.col("places") == 0, "not_found").when(F.col("places") > 1, "ambiguous").otherwise("matched")
    return listed.select("quote_id", "doc_id", status.alias("status"), F.when(F.col("places") == 1, F.col("on")).alias("page"), F.when(F.size("rectangles") > 0, F.col("rectangles")).alias("rectangles"))


def _boxes(words: DataFrame, key: list[str]) -> DataFrame:
    return words.groupBy(*key, "page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _shares() -> dict[str, Column]:
    """A box as shares of its page's width ``w`` and height ``h``."""
    share = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 6)
    return {"x": share(F.col("x0") / F.col("w")), "y": share(F.col("y0") / F.col("h")), "width": share((F.col("x1") - F.col("x0")) / F.col("w")), "height": share((F.col("y1") - F.col("y0")) / F.col("h"))}


def line_rectangles(words: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """key, page, block, line, x, y, width, height: the box around a line's words as shares of the page, 0 to 1, six places."""
    met = _boxes(words, key).join(pages.select("doc_id", "page", F.col("width").alias("w"), F.col("height").alias("h")), ["doc_id", "page"])
    return met.select(*key, "page", "block", "line", *(c.alias(n) for n, c in _shares().items()))


def words_for_spans(spans: DataFrame, text_tokens: DataFrame, words: DataFrame) -> DataFrame:
    """span_id, n of the words under each span of a page's text. Text tokens (doc_id, page, position, token, first, last) and words meet by their place, which each has to itself;
    a page where they differ anywhere gives nothing. Pages are dealt out once, for the comparison and for the spans."""
    kinds = dict(text_tokens.dtypes)
    ours = text_tokens.select("doc_id", "page", "position", F.lit(0).alias("side"), "token", "first", "last")
    theirs = words.select("doc_id", "page", F.col("n").alias("position"), F.lit(1).alias("side"), F.lower("raw").alias("token"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("first", "last")))
    along = Window.partitionBy("doc_id", "page").orderBy("position", "side")
    # A token is followed by the word at its place that equals it, and a word follows its token.
    meets = lambda other: (other("position").over(along) == F.col("position")) & (other("side").over(along) != F.col("side"))
    fits = F.when(F.col("side") == 0, meets(F.lead) & (F.lead("token").over(along) == F.col("token"))).otherwise(meets(F.lag))
    met = ours.unionByName(theirs).repartition("doc_id", "page").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    fine = met.withColumn("_same", F.bool_and("_fits").over(Window.partitionBy("doc_id", "page"))).filter("_same AND side = 0")
    return spans.join(fine, ["doc_id", "page"]).filter("first < end AND last > start").select("span_id", "doc_id", "page", F.col("position").alias("n"))


def attach_evidence(claims: DataFrame, citations: DataFrame, chunks: DataFrame, drafts: DataFrame, longest: int = 500) -> DataFrame:
    """claim_id, chunk_id of supported claims: the cited chunk is of the claim's document and extraction, the quote is short enough, stands in the
    chunk, and the claim stands in the draft. Token lists decide; equal quotes of a chunk count once."""
    cited = claims.filter("supported").join(citations.select("turn_id", "chunk_id").distinct(), ["turn_id", "chunk_id"], "left_semi")
    of = chunks.select("chunk_id", "document_id", "extraction_id")
    sized = cited.join(of, "chunk_id").filter("document_id = claim_document AND extraction_id <=> claim_extraction").filter(F.length("quote") <= longest)
    sized = checkpointed(sized.select("claim_id", "turn_id", "chunk_id", "quote", "claim", tokens(F.col("quote")).alias("q")))
    asked = lambda df, key: df.join(sized.select(key).distinct(), key, "left_semi")
    of_quotes = lambda text, doc: token_table(sized.select(F.struct(F.col("claim_id").alias("quote_id"), F.col(doc).alias("doc_id")).alias("k"), text), "k", text).select("k.*", "tokens")
    of_texts = lambda df, doc, text: token_table(df.select(F.col(doc).alias("doc_id"), text), "doc_id", text)
    in_chunk = phrase_matches(of_quotes("quote", "chunk_id"), of_texts(asked(chunks, "chunk_id"), "chunk_id", "content"))
    in_draft = phrase_matches(of_quotes("claim", "turn_id"), of_texts(asked(drafts, "turn_id"), "turn_id", "draft"))
    both = in_chunk.select("quote_id").distinct().join(in_draft.select("quote_id").distinct(), "quote_id").withColumnRenamed("quote_id", "claim_id")
    kept = sized.join(both, "claim_id", "left_semi").withColumn("mark", F.sha2(F.array_join("q", " "), 256))
    return kept.groupBy("turn_id", "chunk_id", "mark").agg(F.min("claim_id").alias("claim_id")).select("claim_id", "chunk_id")
