"""Writing chunks, graphs and reports so that a rerun changes nothing and half a document is never seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.sources.commits import Store


class CountMismatch(ValueError):
    """What would be written isn't as many rows as its run declares."""


def chunk_store(spark: SparkSession, path: str) -> Store:
    """``chunks`` (and what a stream keeps beside them) by extraction."""
    return Store(spark, path, "extraction_id")


def graph_store(spark: SparkSession, path: str) -> Store:
    """``provisions``, ``edges`` and ``unresolved`` by document."""
    return Store(spark, path, "document_id")


def checked_counts(chunks: DataFrame, runs: DataFrame) -> None:
    """Raise where an extraction isn't as many chunks as its run declares."""
    found = chunks.groupBy("extraction_id").agg(F.count("*").alias("stored"))
    wrong = found.join(runs.select("extraction_id", "chunk_count"), "extraction_id", "left").filter("chunk_count IS NULL OR stored <> chunk_count")
    bad = wrong.limit(5).collect()
    if bad:
        raise CountMismatch(", ".join(f"{r.extraction_id}: {r.stored} of {r.chunk_count}" for r in bad))


def write_chunks(chunks: DataFrame, runs: DataFrame, path: str) -> int:
    """Replace exactly the extractions in ``chunks``, as one version (its number is returned): a reader sees all of them or none, and a write that
    fails leaves what was there. Counts are compared with the runs before anything is written."""
    checked_counts(chunks, runs)
    return chunk_store(chunks.sparkSession, path).commit({"chunks": chunks}, chunks.select("extraction_id"))


GRAPH_TABLES = ("provisions", "edges", "unresolved")


def write_graph(provisions: DataFrame, edges: DataFrame, unresolved: DataFrame, path: str) -> int:
    """Replace the graphs of the documents in any of the tables, in all three as one version."""
    tables = dict(zip(GRAPH_TABLES, (provisions, edges, unresolved)))
    documents = reduce(DataFrame.union, [df.select("document_id") for df in tables.values()])
    return graph_store(provisions.sparkSession, path).commit(tables, documents)


def graph_marks(tables: dict[str, DataFrame]) -> DataFrame:
    """document_id, part, rows, mark of each document's rows in the named tables: their number, and a sum of row hashes that doesn't depend on order."""
    parts = []
    for name, df in tables.items():
        mark = F.sum(F.xxhash64(*sorted(c for c in df.columns if c != "document_id")).cast("decimal(38,0)")).cast("string")
        counted = df.groupBy(F.col("document_id").cast("string").alias("document_id")).agg(F.count("*").alias("rows"), mark.alias("mark"))
        parts.append(counted.select("document_id", F.lit(name).alias("part"), "rows", "mark"))
    return reduce(DataFrame.unionByName, parts)


def verify_graph(expected: DataFrame, path: str) -> DataFrame:
    """document_id, part, rows, stored_rows, same of the documents whose stored rows aren't the expected ones (``graph_marks``), by number or content."""
    store = graph_store(expected.sparkSession, path)
    version = store.version()
    stored = graph_marks({name: store.read(name, version=version) for name in GRAPH_TABLES})
    met = expected.join(stored.select("document_id", "part", F.col("rows").alias("stored_rows"), F.col("mark").alias("stored_mark")), ["document_id", "part"], "full_outer")
    same = F.coalesce(F.col("mark") == F.col("stored_mark"), F.lit(False))
    none = F.lit(0).cast("long")
    return met.select("document_id", "part", F.coalesce("rows", none).alias("rows"), F.coalesce("stored_rows", none).alias("stored_rows"), same.alias("same")).filter("NOT same OR rows <> stored_rows")


def write_report(report: DataFrame, path: str, order: list[str]) -> None:
    """A deterministic JSON report; reports are aggregates of a few rows."""
    report.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)
