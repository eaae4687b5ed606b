"""Batches of a document's rows, however many rows a document has.

A batch ends before the row that would make it more than ``n`` rows or ``most`` tokens, so where a batch starts decides where the next one does: starts are pointers from row
to row. Rows lie in sorted ranges, and no task holds a whole document. A batch that is open where a range begins has 1 to ``n`` rows of the ranges before. A range that lies
inside one document therefore states, for each of these numbers, how many rows its last batch has and how many batches it begins, by pointers doubled until they leave it.
The driver composes these statements (``n`` numbers a range, whatever the rows), and each range then deals its rows out on its own.

Defined results: a null or negative size counts as 0; rows without a key are one document; rows without an order come last; rows of equal order go by size; an empty table
gives no rows; columns named _part are not allowed, any others stay.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from corpuslake.sources.scratch import checkpointed


@dataclass
class Open:
    """The batch that the last row went to, with its number in its document."""

    number: int = -1
    rows: int = 0
    tokens: int = 0

    def take(self, size: int, n: int, most: int | None) -> int:
        """The batch of the next row."""
        if not self.rows or self.rows >= n or (most is not None and self.tokens + size > most):
            self.number, self.rows, self.tokens = self.number + 1, 0, 0
        self.rows += 1
        self.tokens += size
        return self.number


def passed_on(sizes: np.ndarray, held: np.ndarray, n: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For an open batch of the last 1, 2, ... len(``held``) rows before: the rows of the last batch after ``sizes``, and the batches begun."""
    m = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    limit = np.iinfo(np.int64).max // 2 if most is None else most
    at = np.arange(m)
    # The first row that doesn't fit any more; a batch has one row at least.
    ahead = np.minimum(np.maximum(np.searchsorted(sums, sums[:-1] + limit, side="right") - 1, at + 1), np.minimum(at + n, m))
    jump, begun, last = np.append(ahead, m), np.append(np.ones(m, dtype=np.int64), 0), np.append(at, 0)
    while (jump[:-1] < m).any():
        last = np.where(jump < m, last[jump], last)
        begun = begun + begun[jump]
        jump = jump[jump]
    rows = np.arange(1, len(held) + 1)
    tokens = np.cumsum(held[::-1])
    start = np.minimum(np.maximum(np.searchsorted(sums, limit - tokens, side="right") - 1, 0), np.minimum(np.maximum(n - rows, 0), m))
    return np.where(start < m, m - last[start], rows + m), begun[start]


def packed(df: DataFrame, n: int, most: int | None, by: str, order: str, tokens: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``batch``, from 0 in each document ``by``: at most ``n`` rows, and of ``tokens`` at most ``most`` unless a row alone has more."""
    size = F.lit(0).cast("long") if tokens is None else F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    keys = [F.col(by), F.col(order).asc_nulls_last(), *([size] if tokens else [])]
    dealt = df.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    ranges = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    narrow = ranges.select("_part", by, size.alias("_size"))
    kind = df.schema[by].dataType

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's first and last document, and the state at its end if the last one begins in it."""
        part = first = last = None
        single, now, tail = True, Open(), deque(maxlen=n)
        for batch in batches:
            for key, x in zip(batch.column(by).to_pylist(), batch.column("_size").to_pylist()):
                if part is None:
                    part, first, last = batch.column("_part")[0].as_py(), key, key
                if key != last:
                    single, last, now = False, key, Open()
                    tail.clear()
                now.take(x, n, most)
                tail.append(x)
        if part is not None:
            of = batch.column(by).type
            made = {"_part": (part, pa.int32()), "first": (first, of), "last": (last, of), "single": (single, pa.bool_()), "number": (now.number, pa.int64()), "rows": (now.rows, pa.int64()), "tail": (list(tail), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in made.values()], list(made))

    stated = StructType().add("_part", IntegerType()).add("first", kind).add("last", kind).add("single", BooleanType())
    stated = stated.add("number", LongType()).add("rows", LongType()).add("tail", ArrayType(LongType()))
    found = sorted(narrow.mapInArrow(ends, stated).collect(), key=lambda r: r["_part"])  # a row for each range
    carried: dict[int, list[int]] = {}
    for before, r in zip(found, found[1:]):
        if r.first == before.last:
            carried[r["_part"]] = ((carried.get(before["_part"], []) if before.single else []) + before.tail)[-n:]
    inside = [r["_part"] for r in found if r.single and r["_part"] in carried]

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, part = [], None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("_part")[0].as_py()
                sizes.append(batch.column("_size").to_numpy())
        if part is not None:
            rows, begun = passed_on(np.concatenate(sizes), np.array(carried[part], dtype=np.int64), n, most)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (rows, begun))], ["_part", "rows", "begun"])

    told = {}
    if inside:
        told = {r["_part"]: r for r in narrow.filter(F.col("_part").isin(inside)).mapInArrow(through, "_part int, rows array<long>, begun array<long>").collect()}
    entry: dict[int, Open] = {}
    now = Open()
    for r in found:
        part, own = r["_part"], Open(r.number, r.rows, sum(r.tail[-r.rows :]))
        if part in carried:
            entry[part] = now
            if r.single:
                rows = told[part].rows[now.rows - 1]
                own = Open(now.number + told[part].begun[now.rows - 1], rows, sum((carried[part] + r.tail)[-rows:]))
        now = own

    sized = ranges.withColumn("_size", size)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, begun = Open(), None, False
        for batch in batches:
            made = []
            for key, x in zip(batch.column(by).to_pylist(), batch.column("_size").to_pylist()):
                if not begun:
                    held = entry.get(batch.column("_part")[0].as_py(), Open())
                    now, last, begun = Open(held.number, held.rows, held.tokens), key, True
                if key != last:
                    now, last = Open(), key
                made.append(now.take(x, n, most))
            kept = [i for i, c in enumerate(batch.schema.names) if c not in ("_part", "_size")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(made, pa.int32())], [*(batch.schema.names[i] for i in kept), "batch"])

    return sized.mapInArrow(deal, StructType(list(df.schema.fields)).add("batch", IntegerType()))


def assign_batches(df: DataFrame, n: int, by: str = "document_id", order: str = "chunk_ordinal", parts: int | None = None) -> DataFrame:
    """Batches of ``n`` rows of each document."""
    return packed(df, n, None, by, order, parts=parts)


def pack_batches(df: DataFrame, n: int, max_tokens: int, by: str = "document_id", order: str = "chunk_ordinal", tokens: str = "tokens", parts: int | None = None) -> DataFrame:
    """Greedy batches of a document's rows: a batch ends before the row that would make it more than ``n`` rows or ``max_tokens``."""
    return packed(df.select(by, order, tokens), n, max_tokens, by, order, tokens, parts)
