"""Benchmark decontamination by a broadcast set of hashed n-grams.

The windows of all benchmark items (n consecutive words; an item of fewer words is one window of its own length) become a table of
word numbers, sorted by a 64-bit hash, which every task holds. A document's words are looked up in the benchmark's vocabulary, the windows
of known words are hashed, looked up in the table, and every hit is verified word by word, so that a collision of hashes never counts.

The table is built for slices of the benchmark of MOST_CHARS characters at most, as counted beforehand, so that what is broadcast has a bound; a larger
benchmark is scanned for slice by slice, and the documents with what was found so far are staged between. Items are cut into
pieces that overlap by n - 1 words, so that a slice's bound holds for items of any length.

Defined results: A-Z are lower-cased, words are runs of digits, letters and anything beyond ASCII; null and empty texts have no words, and are
neither hit nor hit anything; repeated documents give a row each; an item_id with several rows is one item; the words of items
without an id are hit, but such items are not listed; empty tables give no rows, or rows without hits; extra columns are kept in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpuslake.llm.common import ascii_lower, slices, staged

#: Words of a window, and characters of the benchmark that are broadcast at a time.
N, MOST_CHARS = 10, 4_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a piece of an item, and bytes of a text that are words at a time.
PIECE, SLAB = 4096, 1 << 20
_TO = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def _spaced(text: str | None) -> bytes:
    """The text's UTF-8 with A-Z lower-cased and a space for whatever is no part of a word: as long as before."""
    return (text or "").encode().translate(_TO)


def _word_lists(text: str | None) -> Iterator[list[bytes]]:
    raw, at = _spaced(text), 0
    while at < len(raw):
        end = raw.find(b" ", at + SLAB)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _hashed(windows: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers, given as columns."""
    h = np.zeros(len(windows[0]), dtype=np.uint64)
    for column in windows:
        h = (h ^ (column.astype(np.uint64) + np.uint64(1))) * _ODD
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Windows of a slice of the benchmark: a vocabulary, and for each length of windows the hashes in order, the word numbers and the items."""

    def __init__(self, pieces: list[tuple[str | None, str]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in pieces if item is not None})
        number = {name: i for i, name in enumerate(self.names)}
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in pieces:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in text.encode().split(b" ")], dtype=np.int32)
            size = min(n, len(ids))
            found.setdefault(size, []).append((number.get(item, -1), np.lib.stride_tricks.sliding_window_view(ids, size)))
        self.tables = {}
        for size, rows in sorted(found.items()):
            windows, at = np.unique(np.concatenate([w for _, w in rows]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([at.ravel(), np.repeat([i for i, _ in rows], [len(w) for _, w in rows])], axis=1), axis=0)
            hashes = _hashed(windows.T)
            order = np.argsort(hashes, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            pairs = pairs[np.argsort(place[pairs[:, 0]], kind="stable")]
            starts = np.searchsorted(place[pairs[:, 0]], np.arange(len(order) + 1))
            self.tables[size] = hashes[order], windows[order], starts, pairs[:, 1]

    def ids(self, text: str | None) -> np.ndarray:
        """The number of each word of the text; -1 for those that the benchmark doesn't have."""
        get = self.vocab.get
        lists = [np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words)) for words in _word_lists(text)]
        return np.concatenate(lists) if lists else np.empty(0, dtype=np.int32)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts of occurrences, items of theirs) for each length of windows."""
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for size, (hashes, windows, starts, items) in self.tables.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = _hashed([ids[at + j] for j in range(size)])
            row = np.searchsorted(hashes, h)
            met, rows = [], []
            while len(at):  # once more for each further window of the same hash
                same = row < len(hashes)
                same[same] = hashes[row[same]] == h[same]
                at, h, row = at[same], h[same], row[same]
                real = (windows[row] == np.stack([ids[at + j] for j in range(size)], axis=1)).all(axis=1) if len(at) else np.empty(0, dtype=bool)
                met.append(at[real])
                rows.append(row[real])
                row = row + 1
            rows = np.unique(np.concatenate(rows)) if rows else np.empty(0, dtype=np.int64)
            if len(rows):
                yield size, np.concatenate(met), np.unique(np.concatenate([items[starts[r] : starts[r + 1]] for r in rows]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _pieces(benchmark: DataFrame, n: int) -> DataFrame:
    """item, piece: each item's words, joined by one space, in pieces that overlap by n - 1 words."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({WORD})"), F.lit(1))
    read = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - n), F.lit(PIECE))
    return read.select("item", "words", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("words", F.col("at") + 1, F.lit(PIECE + n - 1)), " ").alias("piece"))


def _indexes(benchmark: DataFrame, n: int, most_chars: int) -> Iterator[Index]:
    """An index of each slice of the benchmark; a slice has most_chars characters at most, or is one piece."""
    pieces = _pieces(benchmark, n).distinct()
    slice_of = lambda k: F.pmod(F.xxhash64("item", "piece"), F.lit(k))
    k = 1
    while True:
        sizes = pieces.groupBy(slice_of(k).alias("slice")).agg(F.sum(F.length("piece")).alias("chars"), F.count("*").alias("n"))
        most = sizes.filter("n > 1").agg(F.max("chars")).first()[0] or 0
        if most <= most_chars:
            break
        k *= 2
    for i in range(k):
        yield Index([tuple(r) for r in pieces.filter(slice_of(k) == i).collect()], n)


def _found(docs: DataFrame, index: Broadcast) -> DataFrame:
    """``docs`` (row, n_words, spans, items) with what the index finds added to spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in slices(batches):
            made = []
            for text, spans, items in zip(batch.column("row").field("text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                ids = known.ids(text.as_py())
                places, names = [(s["start"], s["end"]) for s in spans or ()], set(items or ())
                for size, starts, which in known.hits(ids):
                    places += [(s, s + size) for s in starts.tolist()]
                    names |= {known.names[i] for i in which.tolist() if i >= 0}
                made.append((len(ids), [{"start": s, "end": e} for s, e in _merged(places)], sorted(names)))
            n, spans, items = zip(*made) if made else ([], [], [])
            arrays = [batch.column("row"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "spans", "items"])

    return docs.mapInArrow(run, docs.schema)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, most_chars: int = MOST_CHARS) -> DataFrame:
    """row (all columns of ``docs``), n_words, spans (start and end, in words, of what any occurrence of a window covers; apart and in order) and
    items (the item_ids, as strings, whose windows occur; sorted), a row for each document. ``benchmark`` has item_id and text."""
    sc = docs.sparkSession.sparkContext
    fields = [StructField("row", docs.schema), StructField("n_words", LongType()), StructField("spans", SPANS), StructField("items", ArrayType(StringType()))]
    schema = StructType(fields)
    found = docs.select(F.struct("*").alias("row"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields[1:])).to(schema)
    for i, index in enumerate(_indexes(benchmark, n, most_chars)):
        found = _found(staged(found, "scanned") if i else found, sc.broadcast(index))
    return found


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def without_hits(docs: DataFrame, benchmark: DataFrame, whole: bool = False, n: int = N, most_chars: int = MOST_CHARS) -> DataFrame:
    """``docs`` without what the benchmark's windows cover: without those documents if ``whole``, else without the hit words (from each
    span's first character to its last; n_chars, if there is one, follows the text). Other documents stay as they are."""
    found = scan(docs, benchmark, n, most_chars)
    clean = found.filter(F.size("spans") == 0).select("row.*")
    if whole:
        return clean

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, spans in zip(batch.column("row").field("text"), batch.column("spans").to_pylist()):
                raw, left, at = text.as_py().encode(), [], 0
                ends = iter([p for s in spans for p in (s["start"], s["end"] - 1)])
                next_word, inside = next(ends), False
                for i, word in enumerate(_WORD.finditer(_spaced(text.as_py()))):
                    while i == next_word:
                        if inside:
                            at = word.end()
                        else:
                            left.append(raw[at : word.start()])
                        inside, next_word = not inside, next(ends, -1)
                texts.append(b"".join([*left, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "left"])

    schema = StructType([StructField("row", docs.schema), StructField("left", StringType())])
    rest = found.filter(F.size("spans") > 0).select("row", "spans").mapInArrow(cut, schema)
    made = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return clean.unionByName(rest.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns)))
