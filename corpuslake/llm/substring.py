"""Exact removal of repeated passages: seed and extend over winnowed anchors.

A window is ``length`` consecutive words. Winnowing picks, in every window, the word ``seed``-gram with the
least hash; equal windows pick the same gram at the same place, so a gram picked once only can't lie in
a repeated window. Consecutive windows with the same pick form a run: the anchor, and the words to its left and
right that windows of its own reach.

1. Seeds: runs whose anchors occur more than once.
2. Runs equal in anchor and in all words to both sides repeat as a whole; one of each kind goes on.
3. Extension: the kinds of an anchor are each matched with one of them, word by word to the left and to the right. A match of
   ``length`` words or more is a repeat of both. Two kinds can also share a window that the chosen one lacks: then they differ from it in
   the same place by the same word. So each kind's other windows go on to a group of those that differ alike, where the same is done, in ``STEPS`` steps;
   what windows are left in groups of several then are compared by hashes of all their words. Windows are divided between the groups, never copied; and
   copies never meet each other as pairs.
4. Repeats of a document together, overlapping ones as one, are its maximal repeats; their words go.

Anchors are compared by 64-bit hashes, extensions by a 64-bit hash of each word.

Defined results: a null text has no words; a text shorter than a window keeps all; repeated rows repeat
each other, so both lose every word in a full window; a null doc_id is carried along; an empty table gives
no rows. Words are kept unchanged and joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import checkpointed, likely_in, slices, staged

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Most kinds of run that are broadcast: those with more than one run in so many.
HOT = 1000
#: Steps of extension, after which the few windows left in groups are compared one by one.
STEPS = 3
#: Windows whose least gram is looked for at a time.
BLOCK = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()  # of bytes: at ASCII white space only
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Passages:
    """Hashes of any stretch of words of a text."""

    def __init__(self, text: str | None):
        self.words = _word_hashes(text)
        n = len(self.words)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.words * _powers(BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.down = _powers(BASE_INVERSE, n)

    def stretch(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[first]) * self.down[first])


def runs(text: str | None, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """anchor, span (hash of all words), first window, last window, place of the anchor of each run of a text."""
    p = Passages(text)
    n = len(p.words) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    starts = np.arange(len(p.words) - seed + 1)
    grams = p.stretch(starts, starts + seed)
    width = length - seed + 1
    picks = np.empty(n, dtype=np.int64)
    for i in range(0, n, BLOCK):
        view = np.lib.stride_tricks.sliding_window_view(grams[i : i + BLOCK + width - 1], width)[: min(BLOCK, n - i)]
        picks[i : i + len(view)] = view.argmin(1) + np.arange(i, i + len(view))
    first = np.flatnonzero(np.diff(picks, prepend=-1))
    last = np.append(first[1:], n) - 1
    anchor = picks[first]
    shape = ((anchor - first) * (1 << 20) + (last - first)).astype(np.uint64)
    span = _mixed(p.stretch(first, last + length) ^ _mixed(shape + np.uint64(1)))
    return grams[anchor].view(np.int64), span.view(np.int64), first, last, anchor


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), "text")


def _same(left: str = "doc_id", right: str = "at_id") -> Column:
    return F.col(left).eqNullSafe(F.col(right)) & (F.col("rk") == F.col("at_rk"))


def all_runs(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [runs(t, length, seed) for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            keys = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "rk")]
            parts = [pa.array(np.concatenate([x[i] for x in found]).astype(t)) for i, t in enumerate(("i8", "i8", "i4", "i4", "i4"))]
            yield pa.RecordBatch.from_arrays([*keys, *parts], ["doc_id", "rk", "anchor", "span", "first", "last", "at"])

    return _keyed(docs).mapInArrow(run, "doc_id long, rk long, anchor long, span long, first int, last int, at int")


def _contexts(docs: DataFrame, chosen: DataFrame, length: int, seed: int) -> DataFrame:
    """A row for each chosen run: g (its anchor), n, doc_id, rk, at, low and high (how far its windows begin before ``at``),
    left and right: hashes of the words on either side, from the anchor outwards."""
    run_of = F.struct("anchor", "n", "first", "last", "at")
    by_doc = chosen.groupBy(F.col("doc_id").alias("at_id"), F.col("rk").alias("at_rk")).agg(F.collect_list(run_of).alias("runs"))
    texts = likely_in(_keyed(docs), "rk", chosen.select("rk")).join(by_doc.hint("shuffle_hash"), _same()).select("doc_id", "rk", "text", "runs")
    names = ["g", "n", "doc_id", "rk", "at", "low", "high", "left", "right"]
    words = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for doc_id, rk, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rk", "text", "runs"))):
                hashes = _word_hashes(text).view(np.int64)
                for r in found:
                    first, last, at = r["first"], r["last"], r["at"]
                    rows.append((r["anchor"], r["n"], doc_id, rk, at, at - last, at - first, hashes[first:at][::-1], hashes[at + seed : last + length]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), words, words]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return texts.mapInArrow(run, "g long, n long, doc_id long, rk long, at int, low int, high int, left array<long>, right array<long>")


def _reach(a: str, b: str) -> Column:
    """How many leading words of two contexts are the same."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def _extended(entries: DataFrame, length: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(spans, rest) of one step: spans has the windows doc_id, rk, first, last that match with the chosen entry of their group g; rest has
    each entry's other windows, in groups of those that differ from it alike."""
    w = length - seed
    own = F.struct("rk", "at", "doc_id", "n", "left", "right")
    groups = entries.groupBy("g").agg(F.count("*").alias("size"), F.min_by(own, F.struct("rk", "at", "doc_id")).alias("o")).filter("size > 1").select("g", "o")
    met = entries.join(checkpointed(groups), "g")
    met = met.filter(~((F.col("rk") == F.col("o.rk")) & (F.col("at") == F.col("o.at")) & F.col("doc_id").eqNullSafe(F.col("o.doc_id"))))
    met = met.withColumn("l", _reach("left", "o.left")).withColumn("r", _reach("right", "o.right"))
    # A window that begins d words before the anchor takes d words of the left context and w - d of the right one.
    to, since = F.least("high", "l"), F.greatest(F.col("low"), w - F.col("r"))
    met = checkpointed(met.withColumn("to", to).withColumn("since", since))
    hit = met.filter("since <= to")
    mine = hit.filter("n = 1").select("doc_id", "rk", (F.col("at") - F.col("to")).alias("first"), (F.col("at") - F.col("since")).alias("last"))
    its = hit.filter("o.n = 1").select("o.doc_id", "o.rk", (F.col("o.at") - F.col("to")).alias("first"), (F.col("o.at") - F.col("since")).alias("last"))
    go_on = lambda side, place, word, low, high: F.when(low <= high, F.struct(F.xxhash64(F.col("g"), F.lit(side), F.col(place), word).alias("g"), low.alias("low"), high.alias("high")))
    further = go_on(0, "l", F.get("left", F.col("l")), F.greatest(F.col("low"), F.col("l") + 1), F.col("high"))
    nearer = go_on(1, "r", F.get("right", F.col("r")), F.col("low"), F.least(F.col("high"), F.col("l"), w - F.col("r") - 1))
    parts = met.select("n", "doc_id", "rk", "at", "left", "right", F.explode(F.array_compact(F.array(further, nearer))).alias("part"))
    rest = parts.select("part.g", "n", "doc_id", "rk", "at", "part.low", "part.high", "left", "right")
    return mine.union(its).distinct(), rest


def _window_by_window(entries: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, rk, first, last of the windows that another entry of their group g has too."""
    w = length - seed
    around = lambda d: (F.slice("left", F.lit(1), d), F.slice("right", F.lit(1), w - d))
    key = lambda d: F.struct(d.alias("d"), F.xxhash64(F.col("g"), d, *around(d)).alias("h"), F.xxhash64(F.lit(1), *around(d)[::-1], d).alias("i"))
    each = entries.select("n", "doc_id", "rk", "at", F.explode(F.transform(F.sequence("low", "high"), key)).alias("k")).select("n", "doc_id", "rk", "at", "k.*")
    twice = each.groupBy("h", "i").agg(F.sum("n").alias("times")).filter("times > 1").select("h", "i")
    first = F.col("at") - F.col("d")
    return each.filter("n = 1").join(twice, ["h", "i"], "left_semi").select("doc_id", "rk", first.alias("first"), first.alias("last"))


def repeats(docs: DataFrame, length: int = 35, seed: int = 8) -> DataFrame:
    """at_id, at_rk, spans: for each document (doc_id and hash of its text) with repeated windows, packed
    pairs (first window * 2**31 + last window)."""
    every = staged(all_runs(docs, length, seed), "runs")
    often = every.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor")
    # The filters let some anchors pass that occur once, or in one kind: they find no partner.
    seeds = staged(likely_in(every, "anchor", often), "seeds")
    one = F.struct("doc_id", "rk", "first", "last", "at")
    kinds = seeds.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(one).alias("one"))
    kinds = staged(kinds.select("anchor", "span", "n", "one.*"), "kinds")
    again, total = kinds.filter("n > 1").select("anchor", "span", "n"), seeds.count()
    # Kinds that a large share of all runs have, HOT at most, find theirs without a shuffle.
    often, met = F.col("n") * HOT > total, likely_in(seeds, "span", again.select("span"))
    marked = met.join(F.broadcast(again.filter(often)), ["anchor", "span"], "left")
    rest = marked.filter("n IS NULL").join(again.filter(~often).drop("n"), ["anchor", "span"], "left_semi")
    whole = marked.filter("n IS NOT NULL").unionByName(rest).select("doc_id", "rk", "first", "last")
    differing = kinds.groupBy("anchor").agg(F.count("*").alias("spans")).filter("spans > 1").select("anchor")
    spans, rest = [whole], staged(_contexts(docs, likely_in(kinds, "anchor", differing), length, seed), "contexts")
    for _ in range(STEPS):
        found, rest = _extended(rest, length, seed)
        spans.append(found)
        several = rest.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1").select("g")
        rest = checkpointed(likely_in(rest, "g", several))
        if rest.isEmpty():
            break
    else:
        spans.append(_window_by_window(rest, length, seed))
    packed = F.col("first").cast("long") * (1 << 31) + F.col("last")
    both = reduce(DataFrame.union, spans)
    return both.groupBy(F.col("doc_id").alias("at_id"), F.col("rk").alias("at_rk")).agg(F.collect_set(packed).alias("spans"))


def _cut(text: str | None, packed: list[int] | None, length: int) -> tuple[int, int, str]:
    words = (text or "").encode().split()
    n = len(words)
    if packed:
        spans = np.asarray(packed, dtype=np.int64)
        edge = np.bincount(spans >> 31, minlength=n + 1) - np.bincount((spans & ((1 << 31) - 1)) + length, minlength=n + 1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
    return n, n - len(words), b" ".join(words).decode()


def without_repeats(docs: DataFrame, length: int = 35, seed: int = 8) -> DataFrame:
    """``row`` (a struct of the document's own columns) and ``cut``: n_words, n_removed, kept (the words
    that stay)."""
    spans = checkpointed(repeats(docs, length, seed))
    own = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select(*(docs[c].alias(o) for c, o in zip(docs.columns, own)), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("rk"))
    # Documents without repeats are cut, as they are, where they are read.
    met = likely_in(named, "rk", spans.select("at_rk")).join(spans.hint("shuffle_hash"), _same(), "left").select(*own, "spans")
    plain = likely_in(named, "rk", spans.select("at_rk"), False).select(*own, F.lit(None).cast("array<long>").alias("spans"))
    marked = met.union(plain)
    text = own[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cuts = [_cut(t.as_py(), s.as_py(), length) for t, s in zip(batch.column(text), batch.column("spans"))]
            made = [pa.array(c, t) for c, t in zip(zip(*cuts), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*own, "n_words", "n_removed", "kept"])

    schema = T.StructType([*(f for f in marked.schema.fields if f.name in own), *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())))])
    row = F.struct(*(F.col(o).alias(c) for o, c in zip(own, docs.columns)))
    return marked.mapInArrow(run, schema).select(row.alias("row"), F.struct("n_words", "n_removed", "kept").alias("cut"))
