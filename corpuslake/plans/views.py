"""Derived views: documents, chunks, runs, mappings, edges and the rest, made by arithmetic from the stored tables.

Each has a Spark form here and a DuckDB form for the twins of the queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions.keys import document_id
from corpuslake.functions.values import tokens
from corpuslake.operators import segment
from corpuslake.operators.phrases import token_table
from corpuslake.plans.registry import VIEWS_SQL
from corpuslake.sources.scratch import checkpointed

#: White space at the ends of a line, as the twins strip it: no vertical tab, and nothing before a line separator.
_ENDS = r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        split = self.table("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
        clean = split.withColumn("raw", F.regexp_replace("raw", _ENDS, "")).filter("raw <> ''")
        numbered = F.concat(((F.floor(F.col("pos") / 2) % 7) + 1).cast("string"), F.lit(". "), F.col("raw"))
        return clean.select("doc_id", "pos", (F.floor(F.col("pos") / 4) + 1).cast("int").alias("page_number"), F.when(F.col("pos") % 2 == 0, numbered).otherwise(F.col("raw")).alias("line"))

    @cached_property
    def pages(self) -> DataFrame:
        return self.lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))

    @cached_property
    def docs(self) -> DataFrame:
        d = self.table("documents")
        sha = F.sha2(F.coalesce("text", F.lit("")), 256)
        pages = F.greatest(F.lit(1), F.floor((F.size(F.split(F.coalesce("text", F.lit("")), "\n")) - 1) / 4) + 1)
        return d.select("doc_id", document_id(F.col("doc_id").cast("string"), F.col("lang"), sha).alias("document_id"), F.col("doc_id").cast("string").alias("act_number"), F.col("lang").alias("language"), F.col("source").alias("act_title"), sha.alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("byte_size"), pages.cast("int").alias("page_count"), F.concat(F.lit("https://example.org/"), F.col("doc_id"), F.lit(".pdf")).alias("source_url"), F.lit("registered").alias("lifecycle_status"), F.when(F.col("doc_id") % 7 == 0, "ORIGINAL").otherwise("REPRINT").alias("timeline_type"), F.when(F.col("doc_id") % 7 == 0, "original").otherwise("reprint").alias("document_kind"))

    @cached_property
    def sections(self) -> DataFrame:
        return segment.chunk_sections(self.lines, key="doc_id")

    @cached_property
    def chunks(self) -> DataFrame:
        legacy = F.col("doc_id") % 5 == 0
        d = self.docs.select("doc_id", "document_id", "act_number", "language", "act_title")
        return self.sections.join(d, "doc_id").withColumn("document_id", F.when(~legacy, F.col("document_id"))).withColumn("extraction_id", F.when(~legacy, F.concat(F.lit("x-"), "doc_id")))

    @cached_property
    def runs(self) -> DataFrame:
        counted = self.sections.groupBy("doc_id").agg(F.count("*").alias("n"))
        d = self.docs.select("doc_id", "document_id").join(counted, "doc_id", "left")
        return d.select("doc_id", "document_id", F.concat(F.lit("x-"), "doc_id").alias("extraction_id"), (F.coalesce("n", F.lit(0)) + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("chunk_count"), F.when(F.col("doc_id") % 7 == 0, "pending").otherwise("ready").alias("status"))

    @cached_property
    def active(self) -> DataFrame:
        return self.docs.filter("doc_id % 3 <> 0").select("act_number", "language", "document_id", F.concat(F.lit("x-"), "doc_id").alias("extraction_id"), "doc_id")

    @cached_property
    def requests(self) -> DataFrame:
        number = (F.col("doc_id") % 7 + 1).cast("string")
        label = F.when(F.col("doc_id") % 3 == 0, "Section ").when(F.col("doc_id") % 3 == 1, "seksyen ").otherwise("s. ")
        return self.table("documents").select(F.col("doc_id").alias("request_id"), F.concat(label, number, F.lit("(1)")).alias("asked"), F.concat(F.lit("Act "), "doc_id").alias("act"), number.alias("section"), F.col("doc_id").cast("string").alias("act_number"), F.when(F.col("doc_id") % 10 == 0, F.col("source")).alias("act_title"), F.lit(None).cast("string").alias("want_document"), F.lit(None).cast("string").alias("want_extraction"))

    @cached_property
    def citations(self) -> DataFrame:
        number = (F.col("doc_id") % 7 + 1).cast("string")
        act = F.concat(F.lit("Act "), F.col("doc_id"))
        kinds = F.array(F.struct(F.lit(0).alias("pos"), act.alias("act_number"), F.concat(F.lit("Section "), number).alias("section_number")), F.struct(F.lit(1).alias("pos"), act.alias("act_number"), F.lit("s 99").alias("section_number")), F.struct(F.lit(2).alias("pos"), act.alias("act_number"), F.lit("none").alias("section_number")))
        return self.table("documents").select(F.col("doc_id").alias("turn_id"), F.explode(kinds).alias("c")).select("turn_id", "c.*")

    @cached_property
    def edges(self) -> DataFrame:
        """doc_id, side and the fields of one reference for each chunk; odd documents are the later version of the even one before."""
        number = F.regexp_extract("section_number", r"^([0-9]+)", 1).cast("int")
        target = ((number * 3) % 7 + 1).cast("string")
        of = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1).cast("string")
        start = F.length("content")
        rows = self.sections.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "base").otherwise("compare").alias("side"), "section_number", F.col("page_start").alias("page_number"), of.alias("act"), target.alias("target"), start.alias("start_offset"))
        src = F.concat(F.lit("act:"), "act", F.lit("/section:"), "section_number")
        tgt = F.concat(F.lit("act:"), "act", F.lit("/section:"), "target")
        literal = F.concat(F.lit("section "), "target")
        return rows.select("doc_id", "side", F.concat(F.lit("e"), "doc_id", F.lit("-"), "section_number").alias("edge_id"), src.alias("source_provision_id"), tgt.alias("target_provision_id"), F.lit("section").alias("reference_kind"), F.lit("explicit_reference").alias("relationship"), literal.alias("literal"), "page_number", "start_offset", (F.col("start_offset") + F.length(literal)).alias("end_offset"), F.concat(F.lit("d"), "doc_id").alias("document_id"), F.concat(F.lit("x-"), "doc_id").alias("extraction_id"))

    @cached_property
    def provisions(self) -> DataFrame:
        of = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1).cast("string")
        act = F.concat(F.lit("act:"), of)
        size = F.length("content")
        upto = F.sum(size).over(segment.Window.partitionBy("doc_id").orderBy("chunk_ordinal").rowsBetween(segment.Window.unboundedPreceding, 0)).cast("int")
        return self.sections.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "base").otherwise("compare").alias("side"), F.concat(F.lit("d"), "doc_id").alias("document_id"), F.concat(act, F.lit("/section:"), "section_number").alias("provision_id"), F.lit("section").alias("kind"), F.col("section_number").alias("label"), act.alias("parent_id"), (upto - size).alias("start"), upto.alias("end"), "page_start", "page_end")

    @cached_property
    def history(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").cast("int").alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("tokens"))

    @cached_property
    def log(self) -> DataFrame:
        e = self.table("events").filter("event_type IN ('signup', 'purchase', 'error')")
        return e.select(F.col("user_id").cast("string").alias("act_number"), F.lit("en").alias("language"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.when(F.col("event_type") == "error", "rollback").otherwise("activate").alias("action"), F.col("event_id").cast("string").alias("extraction_id"))

    @cached_property
    def cases(self) -> DataFrame:
        labelled = self.table("labels").join(self.table("documents").select("doc_id", "lang", "source"), "doc_id")
        return labelled.select(F.col("doc_id").alias("case_id"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), F.col("source").alias("scenario"), (F.col("doc_id") % 10 == 0).alias("smoke"), F.when(F.col("doc_id") % 4 == 0, "block").otherwise("allow").alias("expected_policy"), (F.col("quality") == 1).alias("judge_passed"), F.coalesce(F.col("toxic"), F.lit(0)).alias("l1_failures"), F.concat(F.lit("Act "), "doc_id").alias("expected_act_number"), F.concat(F.lit("Section "), F.col("doc_id") % 7 + 1).alias("expected_section"), F.array(F.struct(F.col("doc_id").cast("string").alias("act_number"), F.lit("99").alias("section_number")), F.struct(F.lit("").alias("act_number"), F.lit("1").alias("section_number"))).alias("expected_sections"), (F.col("doc_id") % 2 == 0).alias("citation_applicable"), (F.col("doc_id") % 3).cast("int").alias("min_sections_found"))

    @cached_property
    def words(self) -> DataFrame:
        t = F.posexplode(tokens(F.coalesce("text", F.lit("")))).alias("t", "raw")
        return self.table("documents").select("doc_id", t).select("doc_id", F.col("t").alias("n"), (F.floor(F.col("t") / 300) + 1).cast("int").alias("page"), F.lit(0).alias("block"), F.floor(F.col("t") / 10).cast("int").alias("line"), "raw", (F.col("t") % 10 * 10.0).alias("x0"), (F.floor(F.col("t") / 10) % 30 * 20.0).alias("y0"), (F.col("t") % 10 * 10.0 + 9).alias("x1"), (F.floor(F.col("t") / 10) % 30 * 20.0 + 12).alias("y1"))

    @cached_property
    def page_sizes(self) -> DataFrame:
        return self.words.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(100.0).alias("width"), F.lit(600.0).alias("height"))

    @cached_property
    def quotes(self) -> DataFrame:
        return token_table(self.table("benchmark").select(F.col("item_id").alias("quote_id"), F.coalesce("text", F.lit("")).alias("text")), "quote_id", "text")

    @cached_property
    def memory(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("key"), "embedding", F.when(F.col("vec_id") % 9 == 0, "profile").otherwise("topic").alias("kind"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("vec_id") * 3_600_000_000).alias("updated_at"), (F.col("vec_id") % 6).cast("int").alias("recall_count"))

    @cached_property
    def asked_vectors(self) -> DataFrame:
        """The questions: every vector whose id is divisible by 20."""
        return self.table("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").cast("long").alias("user_id"))

    @cached_property
    def near_memory(self) -> DataFrame:
        """``memory`` with planted neighbours, whole vectors that differ from the first in one component or not at all: at a cosine of about 0.96, 1 and 0.64."""
        moved = lambda by: F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == 0, by).otherwise(0.0))
        m = self.memory.withColumn("embedding", moved(0.0))
        topics = m.filter("kind = 'topic'")
        plants = [topics.filter(f"key % {every} = 0").withColumns({"key": F.col("key") + 1_000_000 * n, "embedding": moved(by)}) for n, every, by in ((1, 4, 0.3), (2, 5, 0.0), (3, 8, 1.2))]
        return m.unionByName(plants[0]).unionByName(plants[1]).unionByName(plants[2])

    @cached_property
    def statutes(self) -> tuple[DataFrame, DataFrame]:
        """(pages, documents): an opening page, each document's lines as sections, subsections, paragraphs, subparagraphs, references and Part headings in turn, and a schedule."""
        d = self.table("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
        clean = d.withColumn("raw", F.regexp_replace("raw", _ENDS, "")).filter("raw <> ''")
        i = F.row_number().over(segment.Window.partitionBy("doc_id").orderBy("pos")) - 1
        rows = clean.withColumn("i", i).withColumn("k", F.floor(F.col("i") / 8))
        kind, raw, text = F.col("i") % 8, F.col("raw"), lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
        line = (
            F.when(kind == 0, text((F.col("k") % 9 + 1).cast("string"), ". ", raw))
            .when(kind == 1, text("(", (F.col("k") % 3 + 1).cast("string"), ") ", raw))
            .when(kind == 2, text("(a) ", raw))
            .when(kind == 3, text("(i) ", raw))
            .when(kind == 4, text("(b) ", raw))
            .when(kind == 5, text(raw, " see section ", (F.col("k") % 11 + 1).cast("string"), " of this Act"))
            .when(kind == 6, text("PART ", F.element_at(F.array(F.lit("I"), F.lit("II"), F.lit("IV")), (F.col("k") % 3 + 1).cast("int"))))
            .otherwise(raw)
        )
        body = rows.withColumn("line", line).groupBy("doc_id", (F.col("k") + 2).cast("int").alias("page_number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
        body = checkpointed(body)  # pages and documents are made of it, and are read more than once
        ends = body.groupBy("doc_id").agg(F.max("page_number").alias("last"))
        opening = ends.select("doc_id", F.lit(1).alias("page_number"), F.lit("An Act\n1. Short title").alias("text"))
        schedule = ends.select("doc_id", (F.col("last") + 1).alias("page_number"), F.lit("FIRST SCHEDULE\nForms that section 2 of this Act names").alias("text"))
        of = lambda df: df.withColumn("document_id", F.concat(F.lit("d"), "doc_id")).drop("doc_id")
        documents = ends.select("doc_id", F.col("doc_id").cast("string").alias("act_number"), F.lit("Title").alias("act_title"), (F.col("last") + 1).alias("page_count"))
        return of(opening.unionByName(body).unionByName(schedule)), of(documents)


VIEWS_SQL |= {
    "v_lines": r"""SELECT doc_id, pos, pos // 4 + 1 AS page_number, CASE WHEN pos % 2 = 0 THEN ((pos // 2) % 7 + 1)::VARCHAR || '. ' || raw ELSE raw END AS line
  FROM (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS raw FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)) WHERE raw <> ''""",
    "v_pages": "SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY pos) AS text FROM v_lines GROUP BY ALL",
    "v_docs": r"""SELECT doc_id, 'act-' || doc_id || '-' || lang || '-sha256-' || sha256(coalesce(text, '')) AS document_id, doc_id::VARCHAR AS act_number, lang AS language, source AS act_title, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS byte_size,
  ((len(string_split(coalesce(text, ''), chr(10))) - 1) // 4 + 1)::INT AS page_count, 'https://example.org/' || doc_id || '.pdf' AS source_url, 'registered' AS lifecycle_status, CASE WHEN doc_id % 7 = 0 THEN 'ORIGINAL' ELSE 'REPRINT' END AS timeline_type, CASE WHEN doc_id % 7 = 0 THEN 'original' ELSE 'reprint' END AS document_kind FROM documents""",
    "v_marked": r"""SELECT *, nullif(regexp_extract(line, '^([0-9]{1,3}[A-Z]{0,2})\.\s+\S', 1), '') AS number, lag(line) OVER w AS before, max(page_number) OVER (PARTITION BY doc_id) AS last_page FROM v_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    "v_numbered": "SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM v_marked",
    "v_built": r"""SELECT doc_id, section, last_page, max(number) AS section_number, min(page_number) AS page_start, concat_ws(chr(10), max(CASE WHEN number IS NOT NULL AND length(before) BETWEEN 1 AND 119 AND NOT regexp_matches(before, '^[0-9(]') THEN before END), string_agg(line, chr(10) ORDER BY pos)) AS content
  FROM v_numbered WHERE section > 0 GROUP BY doc_id, section, last_page""",
    "v_raw_sections": "SELECT *, greatest(page_start, coalesce(lead(page_start) OVER (PARTITION BY doc_id ORDER BY section), last_page)) AS page_end FROM v_built",
    "v_last_sections": "SELECT *, min(section) OVER (PARTITION BY doc_id, section_number) AS first_at, row_number() OVER (PARTITION BY doc_id, section_number ORDER BY section DESC) AS n FROM v_raw_sections WHERE length(content) >= 80",
    "v_sections": "SELECT doc_id, section_number, (row_number() OVER (PARTITION BY doc_id ORDER BY first_at) - 1)::INT AS chunk_ordinal, page_start, page_end, content, sha256(content) AS content_sha256 FROM v_last_sections WHERE n = 1",
    "v_chunks": "SELECT s.*, CASE WHEN doc_id % 5 <> 0 THEN document_id END AS document_id, act_number, language, act_title, CASE WHEN doc_id % 5 <> 0 THEN 'x-' || doc_id END AS extraction_id FROM v_sections s JOIN v_docs USING (doc_id)",
    "v_runs": "SELECT doc_id, document_id, 'x-' || doc_id AS extraction_id, coalesce(n, 0) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS chunk_count, CASE WHEN doc_id % 7 = 0 THEN 'pending' ELSE 'ready' END AS status FROM v_docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_sections GROUP BY doc_id) USING (doc_id)",
    "v_active": "SELECT act_number, language, document_id, 'x-' || doc_id AS extraction_id, doc_id FROM v_docs WHERE doc_id % 3 <> 0",
    "v_requests": "SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN 'Section ' WHEN 1 THEN 'seksyen ' ELSE 's. ' END || (doc_id % 7 + 1) || '(1)' AS asked, 'Act ' || doc_id AS act, (doc_id % 7 + 1)::VARCHAR AS section, doc_id::VARCHAR AS act_number, CASE WHEN doc_id % 10 = 0 THEN source END AS act_title FROM documents",
    "v_citations": "SELECT doc_id AS turn_id, unnest([0, 1, 2]) AS pos, 'Act ' || doc_id AS act_number, unnest(['Section ' || (doc_id % 7 + 1), 's 99', 'none']) AS section_number FROM documents",
    "v_edges": r"""SELECT doc_id, side, 'e' || doc_id || '-' || section_number AS edge_id, 'act:' || act || '/section:' || section_number AS source_provision_id, 'act:' || act || '/section:' || target AS target_provision_id, 'section' AS reference_kind, 'explicit_reference' AS relationship, 'section ' || target AS literal, page_number, start_offset, start_offset + length('section ' || target) AS end_offset, 'd' || doc_id AS document_id, 'x-' || doc_id AS extraction_id
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'compare' END AS side, section_number, page_start AS page_number, doc_id - doc_id % 2 AS act, (regexp_extract(section_number, '^([0-9]+)', 1)::INT * 3) % 7 + 1 AS target, length(content) AS start_offset FROM v_sections)""",
    "v_provisions": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'compare' END AS side, 'd' || doc_id AS document_id, 'act:' || (doc_id - doc_id % 2) || '/section:' || section_number AS provision_id, section_number AS label, (sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_ordinal) - length(content))::INT AS start, (sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_ordinal))::INT AS \"end\", page_start, page_end FROM v_sections".replace('\\"', '"'),
    "v_history": r"SELECT conv_id AS thread_id, turn::INT AS pos, role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM conversations",
    "v_log": "SELECT user_id::VARCHAR AS act_number, 'en' AS language, ts, event_id, CASE WHEN event_type = 'error' THEN 'rollback' ELSE 'activate' END AS action, event_id::VARCHAR AS extraction_id FROM events WHERE event_type IN ('signup', 'purchase', 'error')",
    "v_cases": "SELECT doc_id AS case_id, lang AS category, source AS scenario, doc_id % 10 = 0 AS smoke, CASE WHEN doc_id % 4 = 0 THEN 'block' ELSE 'allow' END AS expected_policy, quality = 1 AS judge_passed, coalesce(toxic, 0) AS l1_failures, doc_id % 2 = 0 AS citation_applicable, doc_id % 3 AS min_sections_found FROM labels JOIN documents USING (doc_id)",
    "v_doc_tokens": r"SELECT doc_id, regexp_extract_all(lower(translate(replace(coalesce(text, ''), chr(173), ''), '‐‑‒–—―−‘’‛′＇', '-------''''''''''')), '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*') AS tokens FROM documents",
    "v_full_tokens": r"SELECT doc_id, regexp_extract_all(replace(lower(translate(replace(coalesce(text, ''), chr(173), ''), '‐‑‒–—―−‘’‛′＇', '-------''''''''''')), 'ß', 'ss'), '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*') AS tokens FROM documents",
    "v_quotes": r"SELECT item_id AS quote_id, regexp_extract_all(replace(lower(translate(replace(coalesce(text, ''), chr(173), ''), '‐‑‒–—―−‘’‛′＇', '-------''''''''''')), 'ß', 'ss'), '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*') AS tokens FROM benchmark",
    "v_words": "SELECT doc_id, t AS n, t // 300 + 1 AS page, 0 AS block, t // 10 AS line, raw, (t % 10) * 10.0::DOUBLE AS x0, (t // 10 % 30) * 20.0::DOUBLE AS y0, (t % 10) * 10.0::DOUBLE + 9 AS x1, (t // 10 % 30) * 20.0::DOUBLE + 12 AS y1 FROM (SELECT doc_id, unnest(tokens) AS raw, unnest(range(len(tokens))) AS t FROM v_doc_tokens)",
    "v_memory": "SELECT label::BIGINT AS user_id, vec_id AS key, embedding, CASE WHEN vec_id % 9 = 0 THEN 'profile' ELSE 'topic' END AS kind, make_timestamp(1704067200000000 + vec_id * 3600000000) AS updated_at, (vec_id % 6)::INT AS recall_count FROM embeddings",
    "v_asked": "SELECT vec_id AS query_id, embedding AS query_vec, label::BIGINT AS user_id FROM embeddings WHERE vec_id % 20 = 0",
    "v_doubles": "SELECT * REPLACE (embedding::DOUBLE[] AS embedding) FROM v_memory",
    "v_near": """SELECT *, key AS seed FROM v_doubles
  UNION ALL SELECT * REPLACE (key + 1000000 AS key, list_concat([embedding[1] + 0.3], embedding[2:]) AS embedding), key FROM v_doubles WHERE kind = 'topic' AND key % 4 = 0
  UNION ALL SELECT * REPLACE (key + 2000000 AS key), key FROM v_doubles WHERE kind = 'topic' AND key % 5 = 0
  UNION ALL SELECT * REPLACE (key + 3000000 AS key, list_concat([embedding[1] + 1.2], embedding[2:]) AS embedding), key + 3000000 FROM v_doubles WHERE kind = 'topic' AND key % 8 = 0""",
    "v_statute": r"""SELECT doc_id, 'main' AS part, i, i // 8 + 2 AS page_number, CASE i % 8 WHEN 0 THEN (i // 8 % 9 + 1) || '. ' || raw WHEN 1 THEN '(' || (i // 8 % 3 + 1) || ') ' || raw WHEN 2 THEN '(a) ' || raw WHEN 3 THEN '(i) ' || raw WHEN 4 THEN '(b) ' || raw WHEN 5 THEN raw || ' see section ' || (i // 8 % 11 + 1) || ' of this Act' WHEN 6 THEN 'PART ' || ['I', 'II', 'IV'][i // 8 % 3 + 1] ELSE raw END AS line
  FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, raw FROM (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS raw FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)) WHERE raw <> '')""",
    "v_statute_lines": """SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id, part ORDER BY i) - length(line) - 1 AS ofs, sum(length(line) + 1) OVER (PARTITION BY doc_id, part) - 1 AS size FROM (SELECT * FROM v_statute UNION ALL SELECT DISTINCT doc_id, 'main', unnest([-2, -1]), 1, unnest(['An Act', '1. Short title']) FROM v_statute
  UNION ALL SELECT doc_id, 'schedules', unnest([1, 2]), max(page_number) + 1, unnest(['FIRST SCHEDULE', 'Forms that section 2 of this Act names']) FROM v_statute GROUP BY doc_id)""",
    "v_heads": r"""SELECT *, last_value(CASE WHEN level = 0 THEN ofs END IGNORE NULLS) OVER w AS section_at, last_value(CASE WHEN level = 0 THEN label END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN level = 1 THEN ofs END IGNORE NULLS) OVER w AS sub_at, last_value(CASE WHEN level = 1 THEN label END IGNORE NULLS) OVER w AS sub,
    last_value(CASE WHEN level = 2 THEN ofs END IGNORE NULLS) OVER w AS par_at, last_value(CASE WHEN level = 2 THEN label END IGNORE NULLS) OVER w AS par FROM (
  SELECT *, CASE WHEN regexp_matches(line, '(?i)^[0-9]{1,3}[A-Z]{0,2}\.\s*(\([0-9]+[A-Z]?\)|[A-Z])') THEN 0 WHEN regexp_matches(line, '(?i)^\([0-9]+[A-Z]?\)\s') THEN 1 WHEN regexp_matches(line, '^\([a-z]{1,3}\)\s') AND NOT regexp_matches(line, '^\((i|ii|iii|iv|v|vi|vii|viii|ix|x)\)') THEN 2 WHEN regexp_matches(line, '(?i)^\([ivxlcdm]+\)\s') THEN 3 WHEN regexp_matches(line, '(?i)^PART\s+[XIVLCDM]+[A-Z]?$') THEN 9 END AS level,
    CASE WHEN regexp_matches(line, '^PART ') THEN upper(regexp_extract(line, 'PART\s+(.*)$', 1)) WHEN line[1] = '(' THEN regexp_extract(line, '^\(([^)]*)\)', 1) ELSE upper(regexp_extract(line, '^([0-9]+[A-Za-z]*)', 1)) END AS label FROM v_statute_lines WHERE part = 'main') WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY ofs ROWS UNBOUNDED PRECEDING)""",
    "v_kept_heads": """SELECT * REPLACE (CASE WHEN sub_at >= section_at THEN sub_at END AS sub_at, CASE WHEN sub_at >= section_at AND par_at >= sub_at THEN par_at END AS par_at) FROM v_heads
  WHERE level = 9 OR section_at IS NOT NULL AND (level = 0 OR level = 1 OR sub_at >= section_at AND (level = 2 OR par_at >= sub_at))""",
    "v_head_ends": """SELECT *, coalesce(min(CASE WHEN level = 0 THEN ofs END) OVER (PARTITION BY doc_id ORDER BY ofs RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), size) AS section_end,
    min(CASE WHEN level = 1 THEN ofs END) OVER (PARTITION BY doc_id, section_at ORDER BY ofs RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_sub, min(CASE WHEN level = 2 THEN ofs END) OVER (PARTITION BY doc_id, section_at, sub_at ORDER BY ofs RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_par,
    min(CASE WHEN level = 3 THEN ofs END) OVER (PARTITION BY doc_id, section_at, sub_at, par_at ORDER BY ofs RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_item FROM v_kept_heads""",
    "v_every_node": """SELECT doc_id, 'main' AS part, CASE level WHEN 9 THEN 'act:' || doc_id || '/description:part-' || lower(label) WHEN 0 THEN sec WHEN 1 THEN sec || '/subsection:' || sub WHEN 2 THEN sec || '/subsection:' || sub || '/paragraph:' || par ELSE sec || '/subsection:' || sub || '/paragraph:' || par || '/subparagraph:' || lower(label) END AS provision_id,
    CASE level WHEN 9 THEN 'description' WHEN 0 THEN 'section' WHEN 1 THEN 'subsection' WHEN 2 THEN 'paragraph' ELSE 'subparagraph' END AS kind, CASE level WHEN 9 THEN 'Part ' || label ELSE 'Section ' || section || CASE WHEN level >= 1 THEN '(' || sub || ')' ELSE '' END || CASE WHEN level >= 2 THEN '(' || par || ')' ELSE '' END || CASE WHEN level = 3 THEN '(' || lower(label) || ')' ELSE '' END END AS label,
    CASE WHEN level IN (0, 9) THEN 'act:' || doc_id WHEN level = 1 THEN sec WHEN level = 2 THEN sec || '/subsection:' || sub ELSE sec || '/subsection:' || sub || '/paragraph:' || par END AS parent_id, ofs AS start,
    CASE level WHEN 9 THEN ofs + length(line) WHEN 0 THEN section_end WHEN 1 THEN coalesce(next_sub, section_end) WHEN 2 THEN coalesce(next_par, next_sub, section_end) ELSE coalesce(next_item, next_par, next_sub, section_end) END AS stop, CASE WHEN level = 9 THEN ofs ELSE section_at END AS top_at, CASE WHEN level = 9 THEN ofs + length(line) ELSE section_end END AS top_end
  FROM (SELECT *, 'act:' || doc_id || '/section:' || section AS sec FROM v_head_ends)""",
    "v_nodes": """SELECT * FROM v_every_node QUALIFY row_number() OVER (PARTITION BY doc_id, provision_id ORDER BY start) = 1 UNION ALL SELECT doc_id, 'schedules', 'act:' || doc_id || '/schedule:first', 'schedule', 'First Schedule', 'act:' || doc_id, 0, max(size), 0, max(size) FROM v_statute_lines WHERE part = 'schedules' GROUP BY doc_id
  UNION ALL SELECT DISTINCT doc_id, 'title', 'act:' || doc_id, 'act', 'Act ' || doc_id, NULL, 0, 5, 0, 5 FROM v_statute""",
    "v_references": r"""SELECT doc_id, part, page_number, literal, ofs + instr(line, literal) - 1 AS first, ofs + instr(line, literal) - 1 + length(literal) AS last, regexp_extract(literal, '[0-9]+') AS number FROM (SELECT *, regexp_extract(line, 'section [0-9]+ of this Act') AS literal FROM v_statute_lines) WHERE literal <> ''""",
    "v_owned": """SELECT r.*, n.provision_id AS source, first - n.start AS start_offset FROM v_references r JOIN v_nodes n ON n.doc_id = r.doc_id AND n.part = r.part AND n.start <= first AND n.stop >= last QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.part, first ORDER BY len(string_split(n.provision_id, '/')) DESC, n.provision_id) = 1""",
    "v_audit_references": "SELECT doc_id, doc_id % 10 AS k, EXISTS (SELECT 1 FROM v_nodes n WHERE n.doc_id = o.doc_id AND n.provision_id = 'act:' || o.doc_id || '/section:' || number) AS resolved FROM v_owned o",
    "v_audit_sections": "SELECT doc_id % 10 AS k FROM v_nodes WHERE kind = 'section'",
}
