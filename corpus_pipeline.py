"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

Stages take (spark, docs, sf_dir) and work on all rows that the stage before has kept. All but the last
return the columns of ``documents``; the last returns the pieces of training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import langid, mixing, packing, simhash, substring
from corpuslake.llm.common import fresh, remove, table
from corpuslake.llm.queries import ranks_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's centroids are near to go, and with them null texts and those without a letter; a missing lang is filled in. Where no
    document has a lang there is nothing to learn from, and all stay. Repeated rows are judged alike; an empty table stays empty."""
    return langid.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur again go; documents without any stay as they are."""
    cut = substring.without_repeats(docs)
    text = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept")).otherwise(F.col("row.text"))
    made = {"text": text, "n_chars": F.when(F.col("cut.n_removed") > 0, F.length("cut.kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for; a null source is one of the sources. Texts without words are never taken, repeated rows
    are taken each on its own, and an empty table stays empty."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, end to end, cut into windows of 1024 tokens; a null text is the end mark alone, repeated rows are packed each, an empty table gives no pieces."""
    return packing.pack(docs, ranks_path())


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Classifier, fingerprints and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of training sequences. What a stage has read goes as soon as its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh(spark, name)
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
