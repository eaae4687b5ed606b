"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import ann, decontaminate, divergence, html_text, langid, licenses, media, mixing, packing, simhash, substring, trie, urls
from corpuslake.llm.common import table
from corpuslake.llm.oracle import ORACLE_SQL


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).drop("rk")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and bad: a page shows the document that its path numbers, and has that one's label."""
    shown = F.try_to_number(F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1), F.lit("9" * 18)).cast("long")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) | (F.col("toxic") == 0), 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    return table(spark, sf_dir, "pages").select("page_id", shown.alias("shown")).join(labels, F.col("shown") == F.col("doc_id")).select("page_id", "bad")


def op5_urls(spark: SparkSession, sf_dir: str, outcomes: DataFrame | None = None) -> DataFrame:
    """``outcomes``: page_id and bad (0 or 1) of labelled pages; by default those of ``page_outcomes``."""
    return urls.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir) if outcomes is None else outcomes)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ranks_path())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.encode(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, bare = trie.spliced(trie.numbered(table(spark, sf_dir, "conversations")))
    return trie.prefix_tree(turns, bare).drop("enter", "leave")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit()
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items, (n_hit > 0).alias("contaminated"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (op1_language, op2_neighbours, op3_mixing, op4_html, op5_urls, op6_packing, op7_simhash, op8_substring, op9_licenses, op10_media, op11_prefix_trie, op12_decontaminate, op13_divergence)
}

