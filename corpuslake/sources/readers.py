"""Reading listings, metadata, extraction bundles and word coordinates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions.keys import split_title, trimmed
from corpuslake.sources.schemas import ACT_METADATA, BUNDLE, LISTINGS, WORDS


def listing(raw: DataFrame, act_type: str) -> DataFrame:
    """Records of one kind of listing in the common shape."""
    fields = LISTINGS[act_type]
    columns = {out: F.coalesce(F.col(field), F.lit("")) for out, field in fields.items()}
    if "title" in columns:
        title = split_title(columns.pop("title"))
        columns |= {"title_bm": title["bm"], "title_en": title["en"]}
    if act_type == "translated":
        columns |= {c: trimmed(F.regexp_replace(columns[c], "<[^>]+>", "")) for c in ("title_bm", "title_en")}
    return raw.select(*(c.alias(n) for n, c in columns.items()), F.lit(act_type).alias("act_type"))


def union_listings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_act_listings(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    parts = [listing(spark.read.schema(", ".join(f"`{f}` string" for f in LISTINGS[kind].values())).json(path), kind) for kind, path in paths.items()]
    return union_listings(*parts)


def timeline(meta: DataFrame) -> DataFrame:
    return meta.select("act_number", F.posexplode("timeline").alias("pos", "e")).select("act_number", "pos", "e.*")


def subsidiary(meta: DataFrame) -> DataFrame:
    return meta.select("act_number", F.posexplode("subsidiary_legislation").alias("pos", "e")).select("act_number", "pos", "e.*")


def read_act_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(acts, timeline, subsidiary) from one JSON file an act."""
    meta = spark.read.schema(ACT_METADATA).json(path, multiLine=True)
    return meta.drop("timeline", "subsidiary_legislation"), timeline(meta), subsidiary(meta)


def runs_of(bundles: DataFrame) -> DataFrame:
    return bundles.select("extraction.*")


def chunks_of(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.posexplode("chunks").alias("chunk_ordinal", "c")).select("chunk_ordinal", "c.*")


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, chunks)."""
    bundles = spark.read.schema(BUNDLE).json(path, multiLine=True)
    return runs_of(bundles), chunks_of(bundles)


def flatten_words(raw: DataFrame, documents: DataFrame) -> DataFrame:
    """A row for each word; files whose document and content hash aren't registered together are left out."""
    fine = raw.join(documents.select("document_id", F.col("sha256").alias("document_sha256")), ["document_id", "document_sha256"])
    pages = fine.select("document_id", F.explode("pages").alias("p")).select("document_id", F.col("p.page_number").alias("page"), F.posexplode("p.words").alias("n", "w"))
    number = lambda i, name: F.get("w", F.lit(i)).cast("double").alias(name)
    return pages.select("document_id", "page", "n", number(0, "x0"), number(1, "y0"), number(2, "x1"), number(3, "y1"), F.get("w", F.lit(4)).alias("raw"), *(F.get("w", F.lit(i)).cast("int").alias(c) for i, c in ((5, "block"), (6, "line"), (7, "word"))))


def read_words(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """Gzip files are read as they are; each is one task, so writers should keep a document a file."""
    return flatten_words(spark.read.schema(WORDS).json(path), documents)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def stubs(meta: DataFrame) -> DataFrame:
    """Acts whose details are still missing, by number where they are numbers."""
    return meta.filter(F.coalesce("stub", F.lit(False))).orderBy(F.col("act_number").try_cast("long").asc_nulls_last(), "act_number")


def harvest_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, href, label of every link of a table of pages."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    each = pages.select(key, F.posexplode(anchors).alias("pos", "a"))
    href = F.regexp_extract("a", r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    return each.select(key, "pos", href.alias("href"), trimmed(F.regexp_replace("a", "<[^>]+>", "")).alias("label"))


def timeline_from_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, date, project_id, log_type, raw_url: navigation entries with the file of the content panel of the same date. Of repeated dates the last
    entry's fields count, at the place of the first."""
    attribute = lambda c, name: F.regexp_extract(c, rf"(?i)\bdata-{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    nav = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*\bdata-date\b[^>]*>)"), F.lit(1))).alias("pos", "a"))
    entries = nav.select(key, "pos", attribute("a", "date").alias("date"), attribute("a", "project-id").alias("project_id"), attribute("a", "log-type").alias("log_type")).filter("date <> ''")
    last = entries.groupBy(key, "date").agg(F.min("pos").alias("pos"), F.max_by(F.struct("project_id", "log_type"), "pos").alias("e"))
    panels = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<li\b[^>]*\bdata-date\b[^>]*>.*?</li>)"), F.lit(1))).alias("pos", "li"))
    files = panels.select(key, "pos", attribute("li", "date").alias("date"), F.regexp_extract("li", r"(?is)<iframe\b[^>]*\bdata-src\s*=\s*[\"']([^\"']*)[\"']", 1).alias("raw_url"))
    file = files.groupBy(key, "date").agg(F.max_by("raw_url", "pos").alias("raw_url"))
    return last.join(file, [key, "date"], "left").select(key, "pos", "date", "e.project_id", "e.log_type", F.coalesce("raw_url", F.lit("")).alias("raw_url"))
