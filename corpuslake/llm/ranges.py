"""Sorted ranges of a table, and sums that run through them: a group may lie in many ranges, and no group meets in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslake.llm.common import checkpointed


def ranged(df: DataFrame, *by: str | Column, parts: int | None = None) -> DataFrame:
    """``df`` in even ranges of ``by``, each sorted, with the range's number ``part``."""
    dealt = df.repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    return checkpointed(dealt.withColumn("part", F.spark_partition_id()))


def _runs(keys: np.ndarray) -> np.ndarray:
    """For each row the first row of its run of equal keys."""
    first = np.empty(len(keys), dtype=bool)
    first[:1] = True
    first[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def running(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``df`` (of ``ranged``, by ``key`` first; long columns without nulls) with v_before and v_sum for each of ``values``: sums over the rows of
    the same key before a row, without and with it. Sums wrap around at 64 bits.

    Two passes: each range tells what its last key adds up to, a row a range, and what the ranges before have of a range's first key goes into the second pass."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        sums = np.zeros(len(values), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _longs(batch, key)
            part = batch.column("part")[0].as_py()
            first = int(keys[0]) if first is None else first
            tail = int(_runs(keys)[-1])
            if tail or int(keys[-1]) != last:
                sums[:] = 0
            last = int(keys[-1])
            sums += [_longs(batch, v)[tail:].sum() for v in values]
        if part is not None:
            made = [[part], [first], [last], [sums.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())])], ["part", "first", "last", "sums"])

    # A row for each range, whatever their rows.
    found = df.select("part", key, *values).mapInArrow(ends, "part int, first long, last long, sums array<long>").collect()
    carried, last, so_far = {}, None, np.zeros(len(values), dtype=np.int64)
    for r in sorted(found):
        if r.first != last:
            so_far = np.zeros(len(values), dtype=np.int64)
        carried[r.part] = so_far
        so_far = so_far + np.array(r.sums, dtype=np.int64) if r.first == r.last else np.array(r.sums, dtype=np.int64)
        last = r.last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, made = _longs(batch, key), []
            if before is None:
                last, before = int(keys[0]), carried[batch.column("part")[0].as_py()]
            start, since = _runs(keys), []
            for v, had in zip(values, before):
                x = _longs(batch, v)
                total = np.cumsum(x)
                ahead = total - x
                ahead = ahead - ahead[start]
                if int(keys[0]) == last:
                    ahead = np.where(start == 0, ahead + had, ahead)
                made += [ahead, ahead + x]
                since.append((ahead + x)[-1])
            last, before = int(keys[-1]), np.array(since, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], [*batch.schema.names, *(f"{v}_{x}" for v in values for x in ("before", "sum"))])

    schema = StructType(list(df.schema))
    for v in values:
        schema = schema.add(f"{v}_before", "long").add(f"{v}_sum", "long")
    return df.mapInArrow(run, schema)


def previous(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` (of ``ranged``) with last_c for each of ``columns``: the value in the row before, through all ranges; null in the first row."""
    at_end = F.max_by(F.struct(*columns), "row").alias("end")
    numbered = df.select("part", *columns, F.monotonically_increasing_id().alias("row"))  # rises within a range
    carried, end = {}, None
    for r in sorted(numbered.groupBy("part").agg(at_end).collect(), key=lambda r: r.part):  # a row for each range
        carried[r.part] = end
        end = tuple(r.end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                before, begun = carried[batch.column("part")[0].as_py()], True
            made = []
            for i, c in enumerate(columns):
                x = batch.column(c)
                made.append(pa.concat_arrays([pa.array([before[i] if before else None], x.type), x[:-1]]))
            before = tuple(batch.column(c)[-1].as_py() for c in columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f"last_{c}" for c in columns)])

    schema = StructType(list(df.schema))
    for c in columns:
        schema = schema.add(f"last_{c}", df.schema[c].dataType)
    return df.mapInArrow(run, schema)
