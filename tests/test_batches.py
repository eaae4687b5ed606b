"""Batches of a document's rows against a plain loop over them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import batches


def plain(rows, n, most):
    """(document, order, size, batch) of each row, one after the other."""
    out, last, now = [], object(), None
    for doc, place, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is None, r[1] or 0, max(r[2] or 0, 0))):
        s = max(size or 0, 0)
        if doc != last:
            last, now = doc, [-1, 0, 0]
        if not now[1] or now[1] >= n or (most is not None and now[2] + s > most):
            now = [now[0] + 1, 0, 0]
        now[1] += 1
        now[2] += s
        out.append((doc, place, size, now[0]))
    return out


def known(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("n, most", [(1, 5), (4, 30), (7, 1000), (3, 0), (50, 90)])
def test_documents_through_many_ranges(spark, n, most):
    rng = random.Random(n * 1000 + most)
    rows = [(d, i, rng.choice([0, 0, 1, 3, 9, 20, 45, None, -2])) for d, size in [("a", 300), ("b", 1), ("c", 40), ("d", 2), ("e", 500), (None, 30)] for i in range(size)]
    rows += [("e", None, 4), ("e", None, 7), ("c", 3, 3), ("c", 3, 3)]  # without an order, and ties
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "document_id string, chunk_ordinal int, tokens int")
    for parts in (1, 9, 37):
        got = [tuple(r) for r in batches.pack_batches(df, n, most, parts=parts).collect()]
        assert known(got) == known(plain(rows, n, most))
    fixed = batches.assign_batches(df.withColumn("note", F.lit("x")), n, parts=9)
    assert fixed.columns == [*df.columns, "note", "batch"]
    # Ties have no order without sizes.
    assert sorted(r.batch for r in fixed.collect()) == sorted(r[3] for r in plain(rows, n, None))


def test_nothing_to_pack(spark):
    assert batches.pack_batches(spark.createDataFrame([], "document_id string, chunk_ordinal int, tokens long"), 3, 10).collect() == []


def test_one_document_over_several_tasks(spark):
    """A document of a million rows lies in many ranges, with the batches of a loop over it."""
    n, most, rows = 100, 2500, 1_000_000
    df = spark.range(rows).select(F.lit("d").alias("document_id"), F.col("id").alias("chunk_ordinal"), (F.xxhash64("id") % 40 + 40).alias("tokens"))
    got = batches.pack_batches(df, n, most, parts=8)
    assert got.groupBy(F.spark_partition_id()).count().count() == 8
    made = got.toPandas().sort_values("chunk_ordinal")
    sizes, batch = made.tokens.to_numpy(), made.batch.to_numpy()
    held, count, want = 0, 0, []
    number = 0
    for s in sizes.tolist():
        if count and (count >= n or held + s > most):
            number, held, count = number + 1, 0, 0
        held, count = held + s, count + 1
        want.append(number)
    assert np.array_equal(batch, want)
