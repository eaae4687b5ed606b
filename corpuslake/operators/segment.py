"""Splitting page text into sections, and ordering rules that keep one of several rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a numbered heading such as ``12A. Text``.
BOUNDARY = r"^([0-9]{1,3}[A-Z]{0,2})\.\s+\S"
LEAST_CHARS, LONGEST_TITLE = 80, 120
SCANNED_BELOW = 100


def segment(lines: DataFrame, boundary: str = BOUNDARY, key: str = "document_id") -> DataFrame:
    """key, section_number, opened_at, page_start, page_end, content, from key, page_number, pos, line.

    A boundary line opens a section, under the line before it if that reads like a title; the title's line
    stays the end of the section before as well. A section's last page is that where the next one opens. Sections of
    one document are built in the tasks that hold its lines, which the shuffle by document brings together.
    """
    along = Window.partitionBy(key).orderBy("page_number", "pos")
    marked = lines.withColumn("number", F.nullif(F.regexp_extract("line", boundary, 1), F.lit(""))).withColumn("before", F.lag("line").over(along))
    numbered = marked.withColumn("section", F.count("number").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last_page", F.max("page_number").over(Window.partitionBy(key)))
    title = F.when((F.length("before") > 0) & (F.length("before") < LONGEST_TITLE) & ~F.col("before").rlike(r"^[0-9(]"), F.col("before"))
    built = (
        numbered.filter("section > 0")
        .groupBy(key, "section", "last_page")
        .agg(
            F.max("number").alias("section_number"),
            F.min("page_number").alias("page_start"),
            F.max(F.when(F.col("number").isNotNull(), title)).alias("title"),
            F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("page_number", "pos", "line")))).alias("body"),
        )
    )
    content = F.concat_ws("\n", F.col("title"), F.array_join(F.col("body.line"), "\n"))
    after = F.lead("page_start").over(Window.partitionBy(key).orderBy("section"))
    return built.select(key, "section_number", F.col("section").cast("int").alias("opened_at"), "page_start", F.greatest("page_start", F.coalesce(after, F.col("last_page"))).alias("page_end"), content.alias("content"))


def last_wins(df: DataFrame, key: Sequence[str], order: str, out: str = "first_at") -> DataFrame:
    """The last row of each key, with the place of the key's first row in ``out``."""
    same = Window.partitionBy(*key)
    return df.withColumn(out, F.min(order).over(same)).withColumn("_n", F.row_number().over(same.orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def chunk_sections(lines: DataFrame, boundary: str = BOUNDARY, min_chars: int = LEAST_CHARS, key: str = "document_id") -> DataFrame:
    """key, section_number, chunk_ordinal (from 0), page_start, page_end, content, content_sha256: short sections
    go first, then the last of each number stays, in the order of the numbers' first sections."""
    long = segment(lines, boundary, key).filter(F.length("content") >= min_chars)
    one = last_wins(long, [key, "section_number"], "opened_at")
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("first_at")) - 1
    return one.select(key, "section_number", ordinal.alias("chunk_ordinal"), "page_start", "page_end", "content", F.sha2("content", 256).alias("content_sha256"))


def chunk_set_hash(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """key, chunk_set_hash: of the canonical JSON list of a document's chunks in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fields = {"act_number": text("act_number"), "section_number": text("section_number"), "content_sha256": text("content_sha256"), "page_number": F.col("page_start"), "page_end": F.coalesce("page_end", "page_start"), "language": text("language")}
    stable = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    listed = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_ordinal"), stable.alias("chunk")))).alias("chunks"))
    return listed.select(key, F.sha2(F.to_json(F.col("chunks.chunk"), {"ignoreNullFields": "false"}), 256).alias("chunk_set_hash"))


def scanned(pages: DataFrame, key: str = "document_id", text: str = "text", below: int = SCANNED_BELOW) -> DataFrame:
    """key, characters, pages, scanned: fewer than ``below`` characters a page."""
    summed = pages.groupBy(key).agg(F.sum(F.length(text)).alias("characters"), F.count_distinct("page_number").alias("pages"))
    return summed.withColumn("scanned", F.col("characters") / F.greatest("pages", F.lit(1)) < below)


def page_groups(pages: DataFrame, key: str = "document_id", keep: Sequence[str] = ()) -> DataFrame:
    """key, page_number, part (main or schedules) and what is to be kept, from key, page_number, text. Documents without an opening page have no rows."""
    # What an opening page, an appendix and a schedule's first page hold. Texts are read before pages are dealt out.
    here = lambda cond: F.min(F.when(cond, F.col("page_number"))).over(Window.partitionBy(key))
    opens = F.col("text").rlike(r"(?i)\bAn\s+Act\b") & F.col("text").rlike(r"(?im)^\s*1\.\s*(?=(?:\([0-9]+[A-Z]?\)|[A-Z]))")
    appendix = F.col("text").rlike(r"(?i)\b(?:LIST|TABLE)\s+OF\s+AMENDMENTS\b")
    schedule = F.col("text").rlike(r"(?im)^\s*(?:(?:FIRST|SECOND|THIRD|FOURTH|FIFTH)\s+)?SCHEDULES?\s*$")
    step = pages.select(key, "page_number", *keep, opens.alias("_opens"), appendix.alias("_ends"), schedule.alias("_lists"))
    step = step.withColumn("_body", here(F.col("_opens"))).filter("_body IS NOT NULL AND page_number >= _body")
    step = step.withColumn("_appendix", here(F.col("_ends"))).filter("_appendix IS NULL OR page_number < _appendix")
    step = step.withColumn("_schedule", here(F.col("_lists") & (F.col("page_number") > F.col("_body"))))
    return step.select(key, "page_number", *keep, F.when(F.col("page_number") < F.coalesce("_schedule", F.col("page_number") + 1), "main").otherwise("schedules").alias("part"))


def span_ends(starts: DataFrame, parent: Sequence[str], start: str = "start", parent_end: str = "parent_end") -> DataFrame:
    """``starts`` with ``end``: where the next sibling starts, or the parent ends."""
    following = F.lead(start).over(Window.partitionBy(*parent).orderBy(start))
    return starts.withColumn("end", F.coalesce(following, F.col(parent_end)))


def with_ordinal(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "ordinal") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


