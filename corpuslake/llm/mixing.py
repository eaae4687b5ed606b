"""Mixing sources to target weights: weighted sampling by exponential keys, in DataFrame functions only.

Every document draws one exponential key, -ln(u) / quality, from a hash of its doc_id, size and text. Sorted
by key within its source, documents are a weighted sample without replacement (Efraimidis and
Spirakis), at any length of the prefix. A source's target gives whole epochs, in which every document is
taken, and a rest, which the sorted prefix fills; the document at the end of the prefix is cut there.

The weight is the probability of good quality that a small model, counted from labelled documents, gives a document;
or any column of the caller's; or, where neither is given, the share of letters in the text.

Running sums don't need a source in one task: Spark deals all documents out in ranges of (source, key), words are summed
per source and range (a few rows), these are prefix-summed, and documents only within their range. Rows alike in all that counts are one row
with a number until the end.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, after
all others; repeated rows are drawn with equal keys and taken one after the other; targets of an empty
table or of texts without words are 0; extra columns are ignored. Reruns agree: nothing is random.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import WORD, checkpointed, staged, words

#: Sources, in order, weigh these, over and over.
WEIGHTS = (3, 1, 2)
SEED = "mix-1"
#: The least weight of a document, and the labelled documents that a bucket of the quality model counts beforehand.
LEAST, PRIOR = 0.1, 4
#: Rows alike that are written out at a time.
CHUNK = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, rk (the text's MD5), size (words), shown (characters but white space), letters, and weight where it is given."""
    text = F.coalesce(F.col("text"), F.lit(""))
    shown = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = shown - F.length(F.regexp_replace(text, r"[\x20\x09-\x0D\p{L}]+", ""))
    given = [] if weight is None else [weight.cast("double").alias("weight")]
    key = F.md5(F.encode(text, "utf-8")).alias("rk")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key, size_of(text).alias("size"), shown.alias("shown"), letters.alias("letters"), *given)


def buckets() -> list[Column]:
    """What the quality model looks at, in whole numbers: the share of letters in twentieths, the mean length of words, and the hundreds of words."""
    share = F.when(F.col("shown") > 0, F.floor(20 * F.col("letters") / F.col("shown"))).otherwise(0)
    length = F.when(F.col("size") > 0, F.floor(F.col("shown") / F.col("size"))).otherwise(0)
    return [c.cast("int") for c in (share, F.least(length, F.lit(20)), F.least(F.floor(F.col("size") / 100), F.lit(30)))]


def by_letters() -> Column:
    """Share of letters, LEAST at least."""
    return F.coalesce(F.greatest(F.lit(LEAST), F.try_divide(F.col("letters"), F.col("shown"))), F.lit(LEAST))


def fitted(rows: DataFrame, labels: DataFrame) -> Column:
    """The weight of a row of ``read``: the probability of good quality, LEAST at least, by the log odds of its buckets among the labelled
    documents (doc_id, quality 0 or 1; the best label counts). What reaches the driver is a number for each of at most 73 buckets."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("good"))
    each = F.array(*(F.struct(F.lit(i).alias("feature"), b.alias("bucket")) for i, b in enumerate(buckets())))
    met = rows.select("doc_id", each.alias("each")).join(known, F.col("doc_id") == F.col("of")).select("good", F.explode("each").alias("b")).select("good", "b.*")
    counts = met.groupBy("feature", "bucket").agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect()
    total, good = (sum(r[c] for r in counts if r.feature == 0) for c in ("n", "good"))
    p = (good + 1) / (total + 2)
    z = F.lit(round(log(p / (1 - p)), 6))
    for i, bucket in enumerate(buckets()):
        odds = {r.bucket: round(log((r.good + PRIOR * p) / (r.n - r.good + PRIOR * (1 - p))) - log(p / (1 - p)), 6) for r in counts if r.feature == i}
        known_odds = F.create_map(*(F.lit(x) for pair in sorted(odds.items()) for x in pair)) if odds else None
        z = z + (F.coalesce(F.try_element_at(known_odds, bucket), F.lit(0.0)) if odds else F.lit(0.0))
    return F.greatest(F.lit(LEAST), F.round(1 / (1 + F.exp(-z)), 6))


def drawn(docs: DataFrame, labels: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """doc_id, source, rk, size, copies, draw (exponential key): a row for all rows alike."""
    rows = checkpointed(read(docs, weight))
    quality = F.greatest(F.lit(1e-9), F.coalesce("weight", F.lit(LEAST))) if weight is not None else fitted(rows, labels) if labels is not None else by_letters()
    alike = rows.withColumn("quality", quality).groupBy("doc_id", "source", "rk", "size", "quality").agg(F.count("*").alias("copies"))
    mark = F.md5(F.encode(F.concat_ws("/", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "rk"), "utf-8"))
    u = (F.conv(F.substring(mark, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return alike.select("doc_id", "source", "rk", "size", "copies", (-F.log(u) / F.col("quality")).alias("draw"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, from source and source_size (a row for each source).

    ``share`` times all words is dealt by weight; a source that would get over ``most`` times its own words gets just
    that, and what it can't use goes to the others by weight. Sources settle in the order of words per weight: the
    first k are full where the level that k full ones leave is below the next one's.
    """
    # A row a source: the windows hold as many rows as there are sources.
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("words"),
        F.coalesce(F.sum("source_size").over(fill), F.lit(0)).alias("before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0))).alias("open"),
    )
    level = F.greatest(F.lit(0.0), share * F.col("words") - most * F.col("before")) / F.col("open")
    settled = full.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") < most * F.col("source_size"), F.col("level"))).over(everything))
    target = F.least(most * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), most * F.col("source_size")))
    return settled.select("source", "source_size", target.cast("double").alias("target"))


def planned(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, labels: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """doc_id, source, rk, size, copies, source_size, target, epochs, part: for all rows alike together how often they are taken whole, and
    how many words of theirs the fraction after that takes."""
    dealt = drawn(docs, labels, weight).repartitionByRange("source", "draw", "rk", "doc_id").withColumn("range", F.spark_partition_id())
    draws = staged(dealt.withColumn("words", F.col("size") * F.col("copies")), "draws")
    ranges = draws.groupBy("source", "range").agg(F.sum("words").alias("words"))
    # As many rows a source as there are ranges.
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranges.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    aims = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    placed = ahead.join(aims.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("range").alias("at"), "ahead", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("draw", "rk", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = draws.withColumn("upto", F.sum("words").over(within))
    joined = summed.join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), rest - (F.col("ahead") + F.col("upto") - F.col("words"))))
    return joined.select("doc_id", "source", "rk", "size", "copies", "source_size", "target", epochs.alias("epochs"), part.alias("part"))


def _take(nth: Column) -> Column:
    """Words taken of the nth (from 0) of the rows alike in a row of ``planned``."""
    own = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("part") - nth * F.col("size")))
    return F.col("epochs") * F.col("size") + own


def taken(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, labels: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """doc_id, source, rk, size, source_size, target, taken: a row for each document. ``weight`` is a column of ``docs``; ``labels`` (doc_id, quality) are
    what weights are fitted to where there is none."""
    plan = planned(docs, weights, share, most, labels, weight)
    chunks = plan.withColumn("since", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    rows = chunks.withColumn("nth", F.explode(F.sequence("since", F.least(F.col("since") + CHUNK, F.col("copies")) - 1)))
    return rows.select("doc_id", "source", "rk", "size", "source_size", "target", _take(F.col("nth")).alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(words(text), 1, n.cast("int")), " ")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole but for those that end a source's prefix,
    which keep their first words. The columns are those of ``docs``; n_chars, if there is one, follows the text."""
    plan = planned(docs, **how).filter("epochs > 0 OR part > 0").select(F.col("doc_id").alias("at_id"), F.col("rk").alias("at_rk"), F.col("source").alias("at_from"), "size", "copies", "epochs", "part")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")).alias("rk"), F.col("source").cast("string").alias("from"))
    met = rows.join(plan.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("at_id")) & (F.col("rk") == F.col("at_rk")) & F.col("from").eqNullSafe(F.col("at_from")))
    # Of rows alike all are treated the same, but for those at the end of a source's prefix: these are numbered, within tasks and then across.
    split = (F.col("part") > 0) & (F.col("part") < F.col("copies") * F.col("size")) & (F.col("copies") > 1)
    whole = met.filter(~split).withColumn("nth", F.lit(0).cast("long")).select("row", "size", "epochs", "part", "nth")
    whole = whole.withColumn("part", F.when(F.col("part") > 0, F.least("part", "size")).otherwise(F.col("part")))
    alike = staged(met.filter(split).select("row", "size", "epochs", "part", F.xxhash64("id", "rk", "from").alias("group"), F.spark_partition_id().alias("task")), "alike")
    tasks = alike.groupBy("group", "task").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("group", "task").orderBy("size")) - 1
    numbered = alike.withColumn("own", number).join(tasks.select("group", "task", start.alias("start")), ["group", "task"])
    numbered = numbered.select("row", "size", "epochs", "part", (F.col("own") + F.col("start")).cast("long").alias("nth"))
    each = whole.unionByName(numbered).select("row", F.struct(_take(F.col("nth")).alias("taken"), "size").alias("take")).filter("take.taken > 0")
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("take.taken") / F.col("take.size")))))
    left = F.col("take.taken") - (F.col("copy") - 1) * F.col("take.size")
    text = F.when(left >= F.col("take.size"), F.col("row.text")).otherwise(_first_words(F.col("row.text"), left))
    out = copies.select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
