"""License scans by diagonal voting, in DataFrame functions only.

Every document's rolling word k-grams (pairs for phrases, fours for templates) are hashed, kept where
the hash is one of the table's, exploded and joined to the positions of the same grams in the phrases
and templates, a table of fixed size. A hit at word p
of the document and word t of the template votes for diagonal p - t. Votes are aggregated per
document, template and diagonal before they are shuffled; diagonals of one template that lie close
together (words left out or put in) merge; a hit counts only if its words, not just its hash,
are the template's, and a merged span only if it covers enough of the template and meets a gram that no template
of another label has: notices of one family differ in a word or two.

A header element in each document's list of hits meets a header row of the table, so one pass over the
texts also brings every document, with its word count, to the same aggregation.

Defined results: a null text is empty; documents without words or places have zero counts, nulls, empty label strings
and score 0; repeated rows give a row each; a null doc_id is kept; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import ascii_lower
from corpuslake.llm.notices import NOTICES, OPENINGS

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings, which tell a license alone, and whole notices.
TEMPLATES = OPENINGS | NOTICES
PAIR, FOUR = 2, 4
#: Diagonals of one template at most this far apart are one span.
GAP = 3


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _hash(first, second):
    return F.xxhash64(first, second)


def telling(templates: Mapping[str, str]) -> list[list[bool]]:
    """For each template which of its grams no template of another label has; all of them, where each is shared."""
    grams = [[tuple(w[t : t + FOUR]) for t in range(len(w) - FOUR + 1)] for w in map(_words, templates)]
    labels: dict[tuple[str, ...], set[str]] = {}
    for mine, label in zip(grams, templates.values()):
        for gram in mine:
            labels.setdefault(gram, set()).add(label)
    own = [[len(labels[gram]) == 1 for gram in mine] for mine in grams]
    return [mine if any(mine) else [True] * len(mine) for mine in own]


def gram_table(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """template, label, base, grams, k, t, gram (its words), own (as in ``telling``); hashes are Spark's own."""
    rows: list[tuple] = [(-1, None, False, 1, 0, 0, None, True)]
    own = telling(templates)
    for i, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        k = PAIR if i < len(phrases) else FOUR
        w = _words(text)
        if len(w) < k:
            raise ValueError(f"shorter than {k} words: {text!r}")
        rows += [(i, label, i < len(phrases), len(w) - k + 1, k, t, w[t : t + k], i < len(phrases) or own[i - len(phrases)][t]) for t in range(len(w) - k + 1)]
    made = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, k int, t int, gram array<string>, own boolean")
    pair = lambda i: _hash(F.col("gram")[i], F.col("gram")[i + 1])
    return made.withColumn("h", F.when(F.col("k") == 0, F.lit(0).cast("long")).when(F.col("k") == PAIR, pair(0)).otherwise(_hash(pair(0), pair(2))))


def votes(docs: DataFrame, phrases: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """doc_id, rk, n_words, template, label, base, grams, k, diagonal, votes, met (grams of the template
    found on it) and own (whether one of them is no other label's): one row for each diagonal of each document, and a header row (template -1).

    Only grams whose hash is in the table leave a document's array; each brings its own words along, not the document's."""
    grams = gram_table(docs.sparkSession, phrases, templates)
    known = grams.select("k", "h").distinct().collect()  # as many as the fixed passages have grams
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), F.array_remove(F.split(ascii_lower(text), BETWEEN), "").alias("words"))
    rest = lambda a, i: F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0)))
    head = lambda a, i: F.slice(a, 1, F.greatest(F.size(a) - i, F.lit(0)))
    pairs = listed.select("*", F.size("words").alias("n_words"), F.zip_with(head(F.col("words"), 1), rest(F.col("words"), 1), _hash).alias("pairs"))
    rolled = pairs.select("*", F.zip_with(head(F.col("pairs"), 2), rest(F.col("pairs"), 2), _hash).alias("fours"))

    def met(k: int, name: str) -> Column:
        wanted = ", ".join(f"{r.h}L" for r in known if r.k == k)  # as text: a column for each takes seconds
        places = F.expr(f"filter(sequence(0, size({name}) - 1), i -> get({name}, i) IN ({wanted}))") if wanted else F.array().cast("array<int>")
        found = F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), i.alias("p"), F.get(F.col(name), i).alias("h"), F.slice("words", i + 1, k).alias("said")))
        return F.when(F.size(name) > 0, found).otherwise(F.array().cast("array<struct<k:int,p:int,h:bigint,said:array<string>>>"))

    header = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("h"), F.lit(None).cast("array<string>").alias("said")))
    hits = rolled.select("doc_id", "rk", "n_words", F.explode(F.concat(header, met(PAIR, "pairs"), met(FOUR, "fours"))).alias("hit")).select("doc_id", "rk", "n_words", "hit.*")
    voted = hits.join(F.broadcast(grams), ["k", "h"]).filter((F.col("k") == 0) | (F.col("said") == F.col("gram")))
    return voted.groupBy("doc_id", "rk", "n_words", "template", "label", "base", "grams", "k", (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.collect_set("t").alias("met"), F.bool_or("own").alias("own")
    )


def _merged(found: DataFrame) -> DataFrame:
    """Spans of ``votes``: neighbouring diagonals of one template as one, with the share of its words that they meet. Header rows stay."""
    lines = Window.partitionBy("doc_id", "rk", "template")
    copies = F.max(F.when(F.col("template") == -1, F.col("votes"))).over(Window.partitionBy("doc_id", "rk"))
    near = found.withColumn("copies", copies)
    along = lines.orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    spans = near.withColumn("starts", apart.cast("int")).withColumn("span", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    reach = [F.min(F.col("diagonal") + F.array_min("met")).alias("first"), F.max(F.col("diagonal") + F.array_max("met") + F.col("k") - 1).alias("last")]
    merged = spans.groupBy("doc_id", "rk", "n_words", "copies", "template", "label", "base", "grams", "span").agg(
        F.min("diagonal").alias("start"), *reach, F.first("k").alias("k"), F.flatten(F.collect_list("met")).alias("met"), F.bool_or("own").alias("own")
    )
    # Words of the template that lie in a gram found; there are as many as its text has, however long the document.
    covered = F.size(F.array_distinct(F.flatten(F.transform("met", lambda t: F.sequence(t, t + F.greatest(F.col("k"), F.lit(1)) - 1)))))
    return merged.withColumn("share", covered / (F.col("grams") + F.greatest(F.col("k"), F.lit(1)) - 1))


def spans(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, cover: float = 0.8) -> DataFrame:
    """doc_id, label, template (its number, phrases first), first_word, last_word, share: a row for every place of a phrase and every passage
    that covers ``cover`` of a template or more. Repeated rows of a document give a row each."""
    told = F.when(F.col("base"), F.col("share") == 1).otherwise((F.col("share") >= cover) & F.col("own"))
    found = _merged(votes(docs, phrases, templates)).filter((F.col("template") >= 0) & told)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "label", "template", F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"), "share")


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, cover: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a
    phrase or template that a span covers, of those that cover ``cover`` or more)."""
    merged = _merged(votes(docs, phrases, templates))
    place = F.col("base") & (F.col("share") == 1)
    kept = F.when(F.col("base"), place).otherwise((F.col("share") >= cover) & F.col("own")) & (F.col("template") >= 0)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = merged.groupBy("doc_id", "rk", "n_words", "copies").agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        join(F.when(place, F.col("label"))).alias("base_labels"),
        join(F.when(kept, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
