"""The few functions that Spark has no built-in for, as Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.values import tokens


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


#: ASCII and the Latin-1 signs and letters that NFKC leaves as they are: no text of these alone is composed, and sharp s is all that folding changes but for case.
PLAIN = r"^[\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF]*+\z"


def nfkc_casefold(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: NFKC and full case folding. Rows of ``PLAIN`` characters stay in the JVM; only the others are sent to Python."""
    plain = F.coalesce(F.col(column), F.lit("")).rlike(PLAIN)
    folded = F.replace(F.lower(column), F.lit("ß"), F.lit("ss"))
    return df.filter(plain).withColumn(out, folded).unionByName(df.filter(~plain).withColumn(out, _fold(column)))


def folded_text(c: Column) -> Column:
    """As ``nfkc_casefold``, in a column: all rows go to Python, those of ``PLAIN`` characters without their text."""
    plain = F.coalesce(c, F.lit("")).rlike(PLAIN)
    return F.when(plain, F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))).otherwise(_fold(F.when(~plain, c)))


def hashed_bag(width: int = 64, rows: int = 512) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The default embedder: unit vectors of token counts, each token hashed to a place. Tokens stay in Arrow arrays, so many ``rows`` at a time, of which each distinct token is looked up once; the places last asked for are kept."""
    from hashlib import sha256

    def hashed(word: str) -> int:
        return int.from_bytes(sha256(word.encode()).digest()[:4], "big") % width

    def counted(lists: pa.Array, place: Callable[[str], int]) -> np.ndarray:
        encoded = lists.flatten().dictionary_encode()
        places = np.fromiter(map(place, encoded.dictionary.to_pylist()), dtype=np.int64)
        at = pc.list_parent_indices(lists).to_numpy() * width + places[encoded.indices.to_numpy()]
        return np.bincount(at, minlength=len(lists) * width).reshape(-1, width)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = lru_cache(maxsize=1 << 17)(hashed)
        for lists in batches:
            out = np.zeros((len(lists), width), dtype=np.float32)
            for start in range(0, len(lists), rows):
                n = counted(lists.slice(start, rows), place).astype(float)
                size = np.linalg.norm(n, axis=1, keepdims=True)
                out[start : start + rows] = n / np.where(size > 0, size, 1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))

    return run


def embed(df: DataFrame, column: str, out: str = "embedding", embedder: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | None = None) -> DataFrame:
    """Vectors of a text column by any function from batches of token lists to batches of vectors. It counts as costly: a later explode would
    otherwise have Spark compute it once more, for a filter on its size."""
    made, kind, run = (F.pandas_udf, pd.Series, embedder) if embedder else (F.arrow_udf, pa.Array, hashed_bag())

    def batches(lists):
        yield from run(lists)

    batches.__annotations__ = {"lists": Iterator[kind], "return": Iterator[kind]}
    return df.withColumn(out, made(batches, T.ArrayType(T.FloatType())).asNondeterministic()(tokens(F.col(column))))


def matches(df: DataFrame, text: str, patterns: Sequence[tuple[str, str]], lines: bool = True) -> DataFrame:
    """The columns of ``df`` but ``text``, with a row for each match of the patterns (kind, pattern) in it: kind, literal, first, last
    (half-open, in code points), label and label_at (of the group ``label``, else null), and line: the whole lines that the match stands on, trimmed
    (null without ``lines``: a copy for each match is much where a line is a whole text).

    Patterns are compiled once a task, and texts don't travel with their matches."""
    keep = [f for f in df.schema.fields if f.name != text]
    made = [("kind", T.StringType(), pa.string()), ("literal", T.StringType(), pa.string()), ("first", T.IntegerType(), pa.int32()), ("last", T.IntegerType(), pa.int32()), ("label", T.StringType(), pa.string()), ("label_at", T.IntegerType(), pa.int32()), ("line", T.StringType(), pa.string())]

    def found(rules: list[tuple[str, re.Pattern]], value: str) -> Iterator[tuple]:
        for kind, rule in rules:
            named = "label" in rule.groupindex
            for m in rule.finditer(value):
                line = None
                if lines:
                    since, until = value.rfind("\n", 0, m.start()) + 1, value.find("\n", m.end())
                    line = value[since : until if until >= 0 else len(value)].strip()
                yield kind, m.group(0), m.start(), m.end(), m.group("label") if named else None, m.start("label") if named else None, line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(kind, re.compile(pattern)) for kind, pattern in patterns]
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                rows, values = [], []
                for i, value in enumerate(some.column(text).to_pylist()):
                    for row in found(rules, value or ""):
                        rows.append(i)
                        values.append(row)
                at = pa.array(rows, pa.int64())
                columns = zip(*values) if values else [[]] * len(made)
                yield pa.RecordBatch.from_arrays([*(some.column(f.name).take(at) for f in keep), *(pa.array(c, t) for c, (_, _, t) in zip(columns, made))], [f.name for f in keep] + [n for n, _, _ in made])

    return df.mapInArrow(run, T.StructType([*keep, *(T.StructField(n, t) for n, t, _ in made)]))


def run_places(tokens: Sequence[str], wanted: Sequence[Sequence[str]], seed: int = 8) -> Iterator[tuple[int, int]]:
    """(which of ``wanted``, position) of each place where all tokens of a list of ``wanted`` stand in a row. Each is looked for by the rarest of its runs of ``seed`` tokens."""
    known: dict[int, dict[tuple, list[int]]] = {}
    for which, quote in enumerate(wanted):
        width = min(seed, len(quote))
        if not width or width > len(tokens):
            continue
        if width not in known:
            at = known[width] = {}
            for i, run in enumerate(zip(*(tokens[k:] for k in range(width)))):
                at.setdefault(run, []).append(i)
        at = known[width]
        places, offset = min(((at.get(tuple(quote[i : i + width]), ()), i) for i in range(len(quote) - width + 1)), key=lambda x: len(x[0]))
        for place in places:
            if place >= offset and tokens[place - offset : place - offset + len(quote)] == quote:
                yield which, place - offset


_NEAREST = T.ArrayType(T.StructType([T.StructField("places", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("position", T.IntegerType())]))


@F.arrow_udf(_NEAREST)
def nearest_places(tokens: pa.Array, pages: pa.Array, wanted: pa.Array, since: pa.Array) -> pa.Array:
    """For each list of ``wanted`` tokens of a row: how many places it has among ``tokens`` on the nearest page from ``since`` on, that page, and the first of them. ``pages``
    are those that the tokens stand on, in order."""
    kind = pa.list_(pa.struct([("places", pa.int32()), ("page", pa.int32()), ("position", pa.int32())]))
    out = []
    for start in range(0, len(tokens), 64):
        for words, on, quotes, first in zip(*(a.slice(start, 64).to_pylist() for a in (tokens, pages, wanted, since))):
            found = [{"places": 0, "page": None, "position": None} for _ in quotes or ()]
            for which, position in run_places(words or [], quotes or []):
                best, page = found[which], on[position]
                if first[which] is None or page < first[which] or best["places"] and page > best["page"]:
                    continue
                if not best["places"] or page < best["page"]:
                    best.update(places=1, page=page, position=position)
                else:
                    best.update(places=best["places"] + 1, position=min(best["position"], position))
            out.append(found)
    return pa.array(out, kind)


class MatchTable:
    """Table function: kind, literal, first, last (half-open, in code points) of every match of the patterns (a map from kind to pattern) in a text;
    none in a null text. Patterns are compiled once a task."""

    def __init__(self) -> None:
        self.rules: dict[str, re.Pattern] = {}

    def eval(self, text: str | None, patterns: dict[str, str]) -> Iterator[tuple]:
        for kind, pattern in patterns.items():
            rule = self.rules.get(pattern) or self.rules.setdefault(pattern, re.compile(pattern))
            for m in rule.finditer(text or ""):
                yield kind, m.group(0), m.start(), m.end()


def register_matches(spark: SparkSession, name: str = "text_matches") -> None:
    """Let SQL call ``MatchTable`` by name, in Arrow batches: ``FROM texts, LATERAL text_matches(text, map('number', '[0-9]+'))``."""
    spark.udtf.register(name, F.udtf(MatchTable, returnType="kind string, literal string, first int, last int", useArrow=True))
