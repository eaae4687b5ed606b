"""Audit of how far the sources of a language diverge in their terms, with late materialised strings.

Tasks count terms by group (language and source) and write them once, with a 64-bit digest of each. From there on counts go by digests only. The least and the
greatest string of a digest show whether several terms share it; if so these terms are told apart by their strings, all others by digests alone. Text is joined back
just for the terms that the result keeps.

A term's rate in a group or a language is p = 1 + floor(10^9 (count + 1) / (N + V)), V being the terms that at least ``least_docs`` of the language's documents have and N the sum of
their counts; the divergence of rate p from rate q is floor((p - q)^2 / q). All of it is exact: products are decimals where 64 bits may not do.

Pairs of sources are summed over whole vectors in tiles of sources: tasks add up the tiles of the terms that they hold, so that what is
shuffled are sums, and terms that no source of a tile has are added as one number.

Defined results: null text, lang and source are read as empty strings; repeated rows count again, as documents too; groups without terms have their pairs;
a language of one source has no pairs; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import slices, staged

WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Documents that a language's term needs, terms that are listed for a group, and sources to a side of a tile.
LEAST_DOCS, TOP, TILE = 3, 200, 128
#: A task writes what it has counted when it holds as many terms, or numbers of a document's terms.
MOST_TERMS, MOST_PENDING = 500_000, 2_000_000
#: Bytes of a text that are words at a time.
SLAB = 1 << 20
_TO = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


class _Numbers(dict):
    """A number for each new word."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _word_lists(text: str) -> Iterator[list[bytes]]:
    raw, at = text.encode().translate(_TO), 0
    while at < len(raw):
        end = raw.find(b" ", at + SLAB)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class _Counts:
    """Terms of a task by group: how often, and in how many documents."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.terms, self.groups, self.pending, self.size = _Numbers(), {}, [], 0

    def add(self, group: int, text: str) -> None:
        g = self.groups.setdefault(group, len(self.groups))
        lists = [np.fromiter(map(self.terms.__getitem__, words), dtype=np.int64, count=len(words)) for words in _word_lists(text)]
        if lists:
            ids, n = np.unique(np.concatenate(lists), return_counts=True)
            self.pending.append((g, ids, n))
            self.size += len(ids)

    def rows(self, most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
        """digest, term, and lists of the groups that have it, of how often they do, and in how many documents."""
        if self.pending:
            many, words = len(self.groups), list(self.terms)
            keys = np.concatenate([ids * many + g for g, ids, _ in self.pending])
            met, at, docs = np.unique(keys, return_inverse=True, return_counts=True)
            n = np.zeros(len(met), dtype=np.int64)
            np.add.at(n, at, np.concatenate([n for *_, n in self.pending]))
            groups = np.fromiter(self.groups, dtype=np.int64, count=many)[met % many]
            starts = np.searchsorted(met // many, np.arange(len(words) + 1)).astype(np.int32)
            digests = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)) & self.mask
            for i in range(0, len(words), most):
                cut = starts[i : i + most + 1]
                lists = [pa.ListArray.from_arrays(pa.array(cut - cut[0]), pa.array(x[cut[0] : cut[-1]])) for x in (groups, n, docs)]
                yield pa.RecordBatch.from_arrays([pa.array(digests[i : i + most].view("<i8")), pa.array(words[i : i + most], pa.binary()).cast(pa.string()), *lists], ["digest", "term", "groups", "n", "docs"])
        self.clear()


def _group(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "source")


def _read(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): group and text of each document; lang, source and their number, group, of each group."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups, seed = staged(texts.select("lang", "source").distinct(), "groups"), 0
    while not groups.groupBy(_group(seed)).count().filter("count > 1").isEmpty():  # until no two groups share a number
        seed += 1
    return texts.select(_group(seed).alias("group"), "text"), groups.withColumn("group", _group(seed))


def counted(rows: DataFrame, bits: int = 64) -> DataFrame:
    """digest, term, groups, n, docs: for each task or part of one its terms, from group and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(bits)
        for batch in slices(batches):
            for group, text in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist()):
                counts.add(group, text)
                if len(counts.terms) > MOST_TERMS or counts.size > MOST_PENDING:
                    yield from counts.rows()
        yield from counts.rows()

    return rows.mapInArrow(run, "digest long, term string, groups array<long>, n array<long>, docs array<long>")


def _rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exactly."""
    wide = ((count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(30,0)")
    exact = F.call_function("div", wide, (total + terms).cast("decimal(19,0)"))
    return 1 + F.when(count < (1 << 63) // SCALE - 1, F.call_function("div", (count + 1) * SCALE, total + terms)).otherwise(exact)


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); rates are at most 10^9 + 1, so that 64 bits do."""
    return F.call_function("div", (p - q) * (p - q), q)


def _on(a: str, b: str, *names: str) -> Column:
    made = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in names]
    for c in made[1:]:
        made[0] = made[0] & c
    return made[0]


class Audit:
    """The counts of ``docs`` (text, lang, source), staged, and what is made of them."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = 64):
        rows, known = _read(docs)
        terms = staged(counted(rows, bits), "terms")
        #: digest, low, high: the least and the greatest of the strings that share a digest.
        self.names = staged(terms.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "names")
        shared = self.names.filter("low < high").select("digest", F.lit(True).alias("shared"))
        split = F.lit("")
        if not shared.isEmpty():
            terms = terms.join(shared, "digest", "left")
            split = F.when(F.col("shared"), F.col("term")).otherwise("")
        # Dealt by digest once: sums and windows below need no other shuffle.
        dealt = terms.select("digest", split.alias("split"), "groups", "n", "docs").repartition("digest")
        each = dealt.select("digest", "split", F.inline(F.arrays_zip(F.col("groups").alias("group"), "n", "docs")).alias("group", "n", "docs"))
        counts = each.groupBy("digest", "split", "group").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(known, "group")
        of_lang = Window.partitionBy("lang", "digest", "split")  # a row for each source of a language
        counts = counts.withColumns({"lang_n": F.sum("n").over(of_lang), "lang_docs": F.sum("docs").over(of_lang)})
        #: lang, digest, split, source, n, lang_n of the kept terms; split tells terms of one digest apart, and is empty for others.
        self.kept = staged(counts.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "digest", "split", "n", "lang_n"), "kept")
        langs = self.kept.groupBy("lang", "digest", "split").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = known.drop("group").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source of a language
        zero = F.lit(0).cast("long")
        groups = groups.select("lang", "source", place.alias("place"), *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")))
        #: lang, source, place, total, terms, lang_total, base (the rate of a term that the group doesn't have; null without kept terms).
        self.groups = staged(groups.withColumn("base", F.when(F.col("terms") > 0, _rate(zero, F.col("total"), F.col("terms")))), "groups")

    def top_terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value, rank: the terms of each group that diverge most upwards from their language.

        The value of each group's last rank is found on counts of values; then text is joined to the terms that reach it, ties included."""
        rates = self.kept.join(self.groups.drop("place", "base"), ["lang", "source"])
        p, q = _rate(F.col("n"), F.col("total"), F.col("terms")), _rate(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
        above = rates.select("lang", "source", "digest", "split", p.alias("p"), q.alias("q")).filter("p > q").withColumn("value", _divergence(F.col("p"), F.col("q")))
        values = above.groupBy("lang", "source", "value").agg(F.count("*").alias("many"))
        down = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
        best = values.withColumn("at", F.row_number().over(down)).filter(F.col("at") <= top)
        best = best.withColumn("ahead", F.sum("many").over(down.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("ahead", F.lit(0)) < top)
        last = best.groupBy("lang", "source").agg(F.min("value").alias("last"))
        near = above.join(last, ["lang", "source"]).filter("value >= last").select("lang", "source", "digest", "split", "value")
        item = F.when(F.col("split") != "", F.col("split")).otherwise(F.col("low"))
        named = near.join(self.names.select("digest", "low"), "digest").select("lang", "source", item.alias("item"), "value")
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    def _tiles(self, tile: int) -> DataFrame:
        """lang, a, b (places of two sources), total (of the divergence of a from b over terms that their tile has), met (how many terms these are)."""
        blocks = self.groups.groupBy("lang").agg((F.floor(F.max("place") / tile)).cast("int").alias("last"))
        own = self.groups.select("lang", "source", "total", "terms", F.floor(F.col("place") / tile).cast("int").alias("block"), (F.col("place") % tile).cast("int").alias("spot")).join(blocks, "lang")
        cells = self.kept.join(own, ["lang", "source"]).select("lang", "digest", "split", "block", "last", F.struct("spot", _rate(F.col("n"), F.col("total"), F.col("terms")).alias("p")).alias("cell"))
        each = cells.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        each = each.select("lang", "digest", "split", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cell")
        # No list is longer than a tile is wide.
        rows = each.groupBy("lang", "x", "y", "digest", "split").agg(*(F.collect_list(F.when(F.col("block") == F.col(c), F.col("cell"))).alias(f"{c}_cells") for c in ("x", "y")))
        bases = self.groups.groupBy("lang", F.floor(F.col("place") / tile).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "base"))).alias("bases"))
        of = lambda c: bases.select("lang", F.col("block").alias(c), F.col("bases.base").alias(f"{c}_bases"))
        rows = rows.drop("digest", "split").join(of("x"), ["lang", "x"]).join(of("y"), ["lang", "y"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, list] = {}

            def out() -> Iterator[pa.RecordBatch]:
                for (lang, x, y), (met, there, back) in sums.items():
                    for first, second, total in [(x, y, there)] + [(y, x, back.T)] * (x != y):
                        a, b = np.indices(total.shape)
                        n = total.size
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array((a + first * tile).ravel()), pa.array((b + second * tile).ravel()), pa.array(total.ravel()), pa.array(np.full(n, met))], ["lang", "a", "b", "total", "met"])
                sums.clear()

            for batch in slices(batches, 2048):
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "x", "y"))))
                for key in dict.fromkeys(keys):
                    at = pa.array([i for i, k in enumerate(keys) if k == key])
                    part = batch.take(at)
                    dense = []
                    for c in ("x", "y"):
                        base = np.asarray(part.column(f"{c}_bases")[0].as_py(), dtype=np.int64)
                        cells = part.column(f"{c}_cells")
                        flat = cells.flatten()
                        m = np.repeat(base[None], len(at), axis=0)
                        m[np.repeat(np.arange(len(at)), np.asarray(cells.value_lengths())), np.asarray(flat.field("spot"))] = np.asarray(flat.field("p"))
                        dense.append(m)
                    a, b = dense
                    if key not in sums:
                        if len(sums) >= 32:
                            yield from out()
                        sums[key] = [0, *(np.zeros((a.shape[1], b.shape[1]), dtype=np.int64) for _ in range(2))]
                    sums[key][0] += len(at)
                    for i in range(a.shape[1]):
                        one = a[:, i : i + 1]
                        square = (one - b) ** 2
                        sums[key][1][i] += (square // b).sum(axis=0)
                        if key[1] != key[2]:
                            sums[key][2][i] += (square // one).sum(axis=0)
            yield from out()

        made = rows.mapInArrow(run, "lang string, a long, b long, total long, met long")
        return made.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("met").alias("met"))

    def pairs(self, tile: int = TILE) -> DataFrame:
        """lang, source, item, value, rank: the divergence of each source of a language from each other one, over all kept terms."""
        end = lambda c: self.groups.select("lang", F.col("source").alias(f"{c}_source"), F.col("place").cast("long").alias(c), F.col("base").alias(f"{c}_base"), "terms")
        # The result itself: a row for each source and each other one.
        both = end("a").join(end("b").drop("terms"), "lang").filter("a <> b").join(self._tiles(tile), ["lang", "a", "b"], "left")
        zero = F.lit(0).cast("long")
        rest = F.coalesce((F.col("terms") - F.coalesce("met", zero)) * _divergence(F.col("a_base"), F.col("b_base")), zero)
        made = both.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), (F.coalesce("total", zero) + rest).alias("value"))
        return made.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64, tile: int = TILE) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    made = Audit(docs, least_docs, bits)
    parts = [(made.pairs(tile), "pair"), (made.top_terms(top), "term")]
    a, b = (x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for x, part in parts)
    return a.unionByName(b)
