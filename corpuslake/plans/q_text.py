"""Queries over text: columns, segmentation, lookup and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import keys, policy, values
from corpuslake.operators import lookup, segment
from corpuslake.plans.registry import query
from corpuslake.plans.views import Views
from corpuslake.sources import readers


@query("t1_chunk_sections", "SELECT doc_id, section_number, chunk_ordinal, page_start, page_end, content_sha256 FROM v_sections")
def _(v: Views) -> DataFrame:
    return v.sections.drop("content")


@query("w1_segment", "SELECT doc_id, section_number, section::INT AS opened_at, page_start, page_end, sha256(content) AS mark FROM v_raw_sections")
def _(v: Views) -> DataFrame:
    return segment.segment(v.lines, key="doc_id").withColumn("mark", F.sha2("content", 256)).drop("content")


@query("w2_last_wins", "SELECT doc_id, section_number, first_at::INT AS first_at, section::INT AS opened_at FROM v_last_sections WHERE n = 1")
def _(v: Views) -> DataFrame:
    long = segment.segment(v.lines, key="doc_id").filter(F.length("content") >= 80)
    return segment.last_wins(long, ["doc_id", "section_number"], "opened_at").select("doc_id", "section_number", "first_at", "opened_at")


@query("w3_span_ends", """SELECT doc_id, section_number, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), parent_end)::INT AS "end"
FROM (SELECT doc_id, section_number, (sum(length(content)) OVER w - length(content))::INT AS start, sum(length(content)) OVER (PARTITION BY doc_id)::INT AS parent_end FROM v_sections WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_ordinal))""")
def _(v: Views) -> DataFrame:
    p = v.provisions.select("doc_id", F.col("label").alias("section_number"), "start", F.max("end").over(segment.Window.partitionBy("doc_id")).alias("parent_end"))
    return segment.span_ends(p, ["doc_id"]).drop("parent_end")


@query("w4_first_wins", """SELECT act, section_number, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY act, section_number ORDER BY doc_id) AS n FROM (SELECT doc_id, doc_id - doc_id % 2 AS act, section_number FROM v_sections)) WHERE n = 1""")
def _(v: Views) -> DataFrame:
    rows = v.sections.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 2).alias("act"), "section_number")
    return segment.first_wins(rows, ["act", "section_number"], ["doc_id"])


@query("p4_scanned", "SELECT doc_id, characters, pages, characters / greatest(pages, 1) < 100 AS scanned FROM (SELECT doc_id, sum(length(text))::BIGINT AS characters, count(DISTINCT page_number) AS pages FROM v_pages GROUP BY doc_id)")
def _(v: Views) -> DataFrame:
    return segment.scanned(v.pages, "doc_id")


@query("t5_page_groups", """SELECT doc_id, page_number, CASE WHEN page_number < coalesce(schedule, page_number + 1) THEN 'main' ELSE 'schedules' END AS part
FROM (SELECT *, min(CASE WHEN regexp_matches(text, '(?im)^\\s*(?:(?:FIRST|SECOND|THIRD|FOURTH|FIFTH)\\s+)?SCHEDULES?\\s*$') AND page_number > body THEN page_number END) OVER (PARTITION BY doc_id) AS schedule
  FROM (SELECT *, min(CASE WHEN regexp_matches(text, '(?i)\\b(?:LIST|TABLE)\\s+OF\\s+AMENDMENTS\\b') THEN page_number END) OVER (PARTITION BY doc_id) AS appendix
    FROM (SELECT *, min(CASE WHEN regexp_matches(text, '(?i)\\bAn\\s+Act\\b') AND regexp_matches(text, '(?im)^\\s*1\\.\\s*(?:\\([0-9]+[A-Z]?\\)|[A-Z])') THEN page_number END) OVER (PARTITION BY doc_id) AS body
      FROM (SELECT doc_id, page_number, replace(text, 'An ', 'An Act ') AS text FROM v_pages)) WHERE page_number >= body) WHERE appendix IS NULL OR page_number < appendix)""".replace("\\\\", "\\"))
def _(v: Views) -> DataFrame:
    return segment.page_groups(v.pages.withColumn("text", F.replace("text", F.lit("An "), F.lit("An Act "))), "doc_id")


@query("a4_chunk_set_hash", """SELECT doc_id, sha256('[' || string_agg('{"act_number":"' || act_number || '","content_sha256":"' || content_sha256 || '","language":"' || language || '","page_end":' || page_end || ',"page_number":' || page_start || ',"section_number":"' || section_number || '"}', ',' ORDER BY chunk_ordinal) || ']') AS chunk_set_hash FROM v_chunks GROUP BY doc_id""")
def _(v: Views) -> DataFrame:
    return segment.chunk_set_hash(v.chunks, "doc_id")


@query("f1_canonical_act", r"SELECT turn_id, upper(trim(regexp_replace(trim(act_number), '(?i)^(?:ACT|AKTA)(?:\s+NO\.?)?\s+', ''))) AS act_key FROM v_citations WHERE pos = 0")
def _(v: Views) -> DataFrame:
    return v.citations.filter("pos = 0").select("turn_id", keys.canonical_act(F.col("act_number")).alias("act_key"))


@query("f2_canonical_section", r"SELECT turn_id, pos, upper(regexp_extract(section_number, '(?i)^\s*(?:(?:SECTION|SEKSYEN|ARTICLE|PERKARA|SEC|S)\.?\s*)?([0-9]+[A-Z]{0,2})\b', 1)) AS section_key FROM v_citations")
def _(v: Views) -> DataFrame:
    return v.citations.select("turn_id", "pos", keys.canonical_section(F.col("section_number")).alias("section_key"))


@query("f3_extract_section", r"SELECT request_id, upper(nullif(regexp_extract(asked, '(?i)\b(?:seksyen|sek\.?|section|sec\.?|s\.?)\s*([0-9]+[A-Z]{0,2})\b', 1), '')) AS section FROM v_requests")
def _(v: Views) -> DataFrame:
    return v.requests.select("request_id", keys.extract_section(F.col("asked")).alias("section"))


_HINTS = " ".join(rf"WHEN regexp_matches(lower(q), '\b{n}\b') THEN '{a}'" for n, a in keys.ACT_NAMES.items())


@query("f4_act_hint", rf"""SELECT request_id, CASE {_HINTS} ELSE upper(nullif(regexp_extract(q, '(?i)\bact\s+([0-9]+[A-Z]?)\b', 1), '')) END AS act
FROM (SELECT request_id, CASE WHEN request_id % 5 = 0 THEN 'what says the Penal Code?' WHEN request_id % 5 = 1 THEN 'the pdpa and ' || act ELSE 'see ' || act END AS q FROM v_requests)""")
def _(v: Views) -> DataFrame:
    q = F.when(F.col("request_id") % 5 == 0, "what says the Penal Code?").when(F.col("request_id") % 5 == 1, F.concat(F.lit("the pdpa and "), "act")).otherwise(F.concat(F.lit("see "), "act"))
    return v.requests.select("request_id", keys.act_hint(q).alias("act"))


@query("f5_document_id", "SELECT doc_id, document_id, 'statutes/sha256/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.pdf' AS asset_key FROM v_docs")
def _(v: Views) -> DataFrame:
    return v.docs.select("doc_id", "document_id", keys.asset_key(F.col("sha256")).alias("asset_key"))


@query("f6_ids", """SELECT doc_id, edge_id AS row_id, 'extraction-sha256-' || sha256('{"configuration_hash":"c","document_id":"' || document_id || '","extractor":"e","extractor_version":"1"}') AS run, 'edge:' || left(sha256(source_provision_id || ':' || target_provision_id || ':' || start_offset || ':' || literal), 16) AS edge FROM v_edges""")
def _(v: Views) -> DataFrame:
    c = F.col
    return v.edges.select("doc_id", c("edge_id").alias("row_id"), keys.extraction_id(c("document_id"), F.lit("e"), F.lit("1"), F.lit("c")).alias("run"), keys.edge_id(c("source_provision_id"), c("target_provision_id"), c("start_offset"), c("literal")).alias("edge"))


@query("f7_dates", """SELECT o_orderkey, try_strptime(lenient, '%d/%m/%Y')::DATE::VARCHAR AS lenient, CASE WHEN regexp_matches(lenient, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') THEN try_strptime(lenient, '%d/%m/%Y')::DATE::VARCHAR END AS strict
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '31/02/2020' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) END AS lenient FROM orders)""")
def _(v: Views) -> DataFrame:
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 11 == 0, "31/02/2020").when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.concat_ws("/", F.day(d), F.month(d), F.year(d)))
    rows = v.table("orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", keys.lenient_date(F.col("t")).cast("string").alias("lenient"), keys.strict_date(F.col("t")).cast("string").alias("strict"))


@query("f8_pdf_url", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://lom.agc.gov.my/ilims/upload/' || page_id || ' x.pdf' WHEN 1 THEN url ELSE 'https://lom.agc.gov.my/ilims/' || page_id || '.pdf' END AS pdf_url FROM pages""")
def _(v: Views) -> DataFrame:
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("pdfjs/web/viewer.html?file=../../../ilims/upload/"), "page_id", F.lit("%20x.pdf&embedded=true"))).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("/ilims/"), "page_id", F.lit(".pdf")))
    return v.table("pages").select("page_id", keys.pdf_url(raw).alias("pdf_url"))


@query("f9_encode_url", "SELECT page_id, replace(url || '/a b/%20c', ' ', '%20') AS encoded FROM pages")
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", keys.encode_url(F.concat("url", F.lit("/a b/%20c"))).alias("encoded"))


@query("f10_split_title", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'BM ' || source ELSE '' END AS bm, CASE WHEN doc_id % 2 = 0 THEN 'EN ' || source ELSE source END AS en FROM documents")
def _(v: Views) -> DataFrame:
    links = F.concat(F.lit('<a href="d.php?lang=BM&x=1">BM '), "source", F.lit('</a><br><a href="d.php?lang=BI&x=1"> EN '), "source", F.lit(" </a>"))
    t = keys.split_title(F.when(F.col("doc_id") % 2 == 0, links).otherwise(F.concat(F.lit("<b>"), "source", F.lit("</b>"))))
    return v.table("documents").select("doc_id", t["bm"].alias("bm"), t["en"].alias("en"))


@query("f12_normalize_wording", r"SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS mark FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.sha2(values.normalize_wording(F.col("text")), 256).alias("mark"))


@query("f13_paths", "SELECT edge_id, 1 AS depth, regexp_extract(source_provision_id, '^act:([^/]+)', 1) AS act, regexp_extract(source_provision_id, '/section:([^/]+)', 1) AS section, starts_with(source_provision_id, 'act:' || regexp_extract(source_provision_id, '^act:([^/]+)', 1) || '/') AS below FROM v_edges")
def _(v: Views) -> DataFrame:
    s = F.col("source_provision_id")
    return v.edges.select("edge_id", keys.path_depth(s).alias("depth"), keys.path_act(s).alias("act"), keys.path_section(s).alias("section"), keys.in_scope(s, F.concat(F.lit("act:"), keys.path_act(s))).alias("below"))


@query("f14_scores", "SELECT key, round(power(0.5::DOUBLE, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_at)) / 86400e6) / 30.0), 6) AS recency, round(power(0.5::DOUBLE, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_at)) / 86400e6) / 30.0) + 2.0 * recall_count, 6) AS score FROM v_memory")
def _(v: Views) -> DataFrame:
    now, at = F.lit("2024-02-01").cast("timestamp"), F.col("updated_at")
    return v.memory.select("key", F.round(values.recency(at, now), 6).alias("recency"), F.round(values.memory_score(at, F.col("recall_count"), now), 6).alias("score"))


@query("f15_expand_range", "SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN array_to_string(range(doc_id % 50, doc_id % 50 + doc_id % 9 + 1), ',') END AS numbers FROM documents")
def _(v: Views) -> DataFrame:
    low = F.col("doc_id") % 50
    text = F.when(F.col("doc_id") % 4 == 1, F.concat(low + 5, F.lit(" to "), low)).otherwise(F.concat(low, F.lit(" to "), low + F.col("doc_id") % 9))
    return v.table("documents").select("doc_id", F.array_join(keys.expand_range(text).cast("array<string>"), ",").alias("numbers"))


@query("f16_strip_suffix", "SELECT doc_id, CASE WHEN ends_with(text, 'Apache License, Version 2.0.') THEN length(text) - 28 WHEN ends_with(text, 'MIT License.') THEN length(text) - 12 ELSE length(text) END AS n FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.length(policy.strip_suffix(F.col("text"), ["Apache License, Version 2.0.", "MIT License."])).cast("long").alias("n"))


@query("f17_render_fields", "SELECT doc_id, concat_ws('; ', 'lang: ' || nullif(lang, ''), CASE WHEN doc_id % 3 > 0 THEN 'source: ' || nullif(source, '') END) AS shown FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", values.render_fields(lang=F.col("lang"), source=F.when(F.col("doc_id") % 3 > 0, F.col("source"))).alias("shown"))


@query("f18_snippet", r"""SELECT doc_id, CASE WHEN length(flat) <= 260 THEN flat ELSE regexp_replace(left(flat, 259), '\s+$', '') || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents)""")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", values.snippet(F.col("text")).alias("snippet"))


@query("f20_evidence_pages", "SELECT act, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS pages FROM (SELECT source_provision_id AS act, page_number FROM v_edges) GROUP BY act")
def _(v: Views) -> DataFrame:
    return v.edges.groupBy(F.col("source_provision_id").alias("act")).agg(F.array_join(values.evidence_pages(F.collect_list(F.struct("page_number"))).cast("array<string>"), ",").alias("pages"))


@query("p1_source_language", "SELECT page_id, CASE WHEN page_id % 4 = 0 OR contains(lower(url), 'lang=bm') OR contains(lower(url), '/my/') OR contains(lower(url), '_bm/') THEN 'bm' ELSE 'en' END AS language FROM pages")
def _(v: Views) -> DataFrame:
    detail = F.when(F.col("page_id") % 4 == 0, "x.php?lang=BM").otherwise("")
    return v.table("pages").select("page_id", keys.source_language(detail, F.col("url")).alias("language"))


_MESSAGES = "SELECT thread_id, pos, CASE pos % 4 WHEN 0 THEN 'Is my client subject to this? ' || text WHEN 1 THEN 'You should ask. ' || text WHEN 2 THEN text || ' This does not constitute legal advice.' ELSE text END AS text FROM v_history"


def _messages(v: Views) -> DataFrame:
    t = F.col("text")
    return v.history.withColumn("text", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("Is my client subject to this? "), t)).when(F.col("pos") % 4 == 1, F.concat(F.lit("You should ask. "), t)).when(F.col("pos") % 4 == 2, F.concat(t, F.lit(" This does not constitute legal advice."))).otherwise(t))


@query("p6_escalation", f"SELECT thread_id, pos, regexp_matches(text, '{policy.any_phrase(policy.ESCALATION)}') AS escalates FROM ({_MESSAGES})")
def _(v: Views) -> DataFrame:
    return _messages(v).select("thread_id", "pos", policy.is_escalation(F.col("text")).alias("escalates"))


@query("p7_policy_violations", f"""SELECT thread_id, pos, CASE WHEN regexp_matches(text, '{policy.any_phrase(policy.ESCALATION_IN_DRAFT)}') THEN '{policy.ESCALATED}' ELSE concat_ws('|', CASE WHEN regexp_matches(text, '{policy.any_phrase(policy.ADVICE)}') THEN '{policy.NO_ADVICE}' END, CASE WHEN NOT contains(lower(text), '{policy.DISCLAIMERS[0]}') THEN '{policy.NO_DISCLAIMER}' END) END AS violations FROM ({_MESSAGES})""")
def _(v: Views) -> DataFrame:
    return _messages(v).select("thread_id", "pos", F.array_join(policy.policy_violations(F.col("text")), "|").alias("violations"))


@query("p8_leaks", f"SELECT doc_id, regexp_matches(text, '{policy.UUID}') AS leaks, doc_id % 2 = 0 AND regexp_matches(text, '{policy.REFUSAL.replace(chr(39), chr(39) * 2)}') AS refuses FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '0a1b2c3d-0000-1111-2222-0123456789ab ' || text WHEN 1 THEN text WHEN 2 THEN 'As an AI, ' || text ELSE text END AS text FROM documents)")
def _(v: Views) -> DataFrame:
    d = F.col("doc_id")
    text = F.when(d % 5 == 0, F.concat(F.lit("0a1b2c3d-0000-1111-2222-0123456789ab "), "text")).when(d % 5 == 2, F.concat(F.lit("As an AI, "), "text")).otherwise(F.col("text"))
    return v.table("documents").select("doc_id", policy.uuid_leak(text).alias("leaks"), policy.ai_refusal(text, F.when(d % 2 == 0, "allow").otherwise("block")).alias("refuses"))


@query("p9_register_mismatch", f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(policy.MALAY_WORDS)}') AND NOT regexp_matches(lower(source), '{'|'.join(policy.MALAY_WORDS)}') AS mismatch FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", policy.register_mismatch(F.col("text"), F.col("source")).alias("mismatch"))


@query("p10_reference_intent", f"SELECT thread_id, pos, regexp_matches(text, '(?i){'|'.join(policy.REFERENCE_INTENT)}') OR regexp_matches(role, '(?i){policy.REFERENCE_FEEDBACK}') AS follows FROM (SELECT m.*, role FROM ({_MESSAGES}) m JOIN v_history h USING (thread_id, pos))")
def _(v: Views) -> DataFrame:
    return _messages(v).select("thread_id", "pos", policy.reference_intent(F.col("text"), F.col("role")).alias("follows"))


@query("p11_delivered", f"SELECT thread_id, pos, CASE WHEN pos % 3 = 0 THEN '{policy.FALLBACK}' WHEN pos % 2 = 0 THEN coalesce(nullif(text, ''), role) ELSE role END AS said FROM v_history")
def _(v: Views) -> DataFrame:
    broken = F.when(F.col("pos") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return v.history.select("thread_id", "pos", policy.delivered(broken, F.when(F.col("pos") % 2 == 0, F.col("text")), F.col("role")).alias("said"))


@query("p2_visible_chunks", """SELECT doc_id, section_number, language, document_id IS NULL AS legacy FROM v_chunks c WHERE (document_id IS NOT NULL AND doc_id % 3 <> 0) OR (document_id IS NULL AND NOT EXISTS (SELECT 1 FROM v_active a WHERE a.act_number = c.act_number AND a.language = c.language))""")
def _(v: Views) -> DataFrame:
    return lookup.visible_chunks(v.chunks, v.active).select("doc_id", "section_number", "language", F.col("document_id").isNull().alias("legacy"))


@query("p2_visible_verified", "SELECT doc_id, section_number FROM v_chunks WHERE document_id IS NOT NULL AND doc_id % 3 <> 0")
def _(v: Views) -> DataFrame:
    return lookup.visible_chunks(v.chunks, v.active, "verified").select("doc_id", "section_number")


@query("p3_filter_chunks", "SELECT doc_id, section_number FROM v_chunks WHERE language = 'de'")
def _(v: Views) -> DataFrame:
    return lookup.filter_chunks(v.chunks, language="de").select("doc_id", "section_number")


@query("j3_provenance", "SELECT c.doc_id, section_number, a.document_id IS NOT NULL AS is_active, source_url FROM v_chunks c LEFT JOIN v_active a USING (act_number, language, document_id, extraction_id) LEFT JOIN v_docs d ON d.document_id = c.document_id")
def _(v: Views) -> DataFrame:
    return lookup.with_provenance(v.chunks, v.active.drop("doc_id"), v.docs).select("doc_id", "section_number", "is_active", "source_url")


@query("p14_pdf_url", "SELECT c.doc_id, section_number, CASE WHEN c.document_id IS NOT NULL THEN source_url || '#page=' || page_start WHEN c.doc_id % 2 = 0 THEN 'r' || c.doc_id || '#page=' || page_start ELSE '' END AS pdf_url FROM v_chunks c LEFT JOIN v_docs d ON d.document_id = c.document_id")
def _(v: Views) -> DataFrame:
    reprints = v.docs.filter("doc_id % 2 = 0").select("act_number", F.concat(F.lit("r"), "doc_id").alias("reprint_url"))
    rows = v.chunks.join(v.docs.select("document_id", "source_url"), "document_id", "left")
    return lookup.with_pdf_url(rows, reprints).select("doc_id", "section_number", "pdf_url")


@query("j2_titles", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'T ' || source END AS act_title FROM documents")
def _(v: Views) -> DataFrame:
    d = v.table("documents")
    index = d.select(F.col("doc_id").cast("string").alias("act_number"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), "source", "doc_id").select("act_number", "pos", F.when((F.col("pos") == 0) | (F.col("doc_id") % 4 == 0), "").otherwise(F.concat(F.lit(" T "), "source")).alias("title_en"), F.lit("").alias("title_bm"))
    docs = d.select("doc_id", F.col("doc_id").cast("string").alias("act_number"), F.lit("en").alias("language"))
    return lookup.with_title(docs, lookup.title_map(index)).select("doc_id", "act_title")


_EXACT = """SELECT request_id, doc_id, section_number, rank FROM (SELECT request_id, c.doc_id, c.section_number, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN c.act_number = r.act_number THEN 0 ELSE 1 END, CASE WHEN language = 'en' THEN 0 ELSE 1 END, c.act_number, language, document_id NULLS FIRST, chunk_ordinal) AS rank
FROM v_requests r JOIN v_chunks c ON upper(c.section_number) = r.section AND (c.act_number = r.act_number OR contains(lower(c.act_title), lower(r.act_title)))) WHERE rank <= 3"""


@query("k2_exact_lookup", _EXACT)
def _(v: Views) -> DataFrame:
    return lookup.exact_lookup(v.chunks, v.requests).select("request_id", "doc_id", "section_number", "rank")


@query("k3_retrieve", f"SELECT request_id, rank, 'exact' AS via FROM ({_EXACT}) UNION ALL SELECT doc_id, 1, 'semantic' FROM documents WHERE doc_id NOT IN (SELECT request_id FROM ({_EXACT}))")
def _(v: Views) -> DataFrame:
    exact = lookup.exact_lookup(v.chunks, v.requests).select("request_id", "rank")
    semantic = v.table("documents").select(F.col("doc_id").alias("request_id"), F.lit(1).alias("rank"))
    return lookup.retrieve(exact, semantic)


@query("j6_missing_sections", "SELECT doc_id::VARCHAR AS act_number, s AS section_number FROM (SELECT doc_id, unnest([(doc_id % 7 + 1)::VARCHAR, '99']) AS s FROM documents) WHERE NOT EXISTS (SELECT 1 FROM v_sections c WHERE c.doc_id = documents.doc_id AND section_number = s)".replace("c.doc_id = documents.doc_id", "c.doc_id = q.doc_id").replace("FROM documents) WHERE", "FROM documents) q WHERE"))
def _(v: Views) -> DataFrame:
    return lookup.missing_sections(v.citations, v.chunks)


@query("j7_citations_missing", "SELECT q.turn_id, q.pos FROM v_citations q WHERE pos < 2 AND NOT EXISTS (SELECT 1 FROM v_sections c WHERE c.doc_id = q.turn_id AND section_number = CASE WHEN pos = 0 THEN (q.turn_id % 7 + 1)::VARCHAR ELSE '99' END)")
def _(v: Views) -> DataFrame:
    return lookup.citations_not_in_corpus(v.citations, v.chunks).select("turn_id", "pos")


def _turn_rows(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    d = v.table("documents").select("doc_id")
    cited = v.citations.filter("turn_id % 4 <> 0")
    retrieved = v.sections.select(F.col("doc_id").alias("turn_id"), F.col("doc_id").cast("string").alias("act_number"), "section_number", (F.col("chunk_ordinal") + 1).alias("rank"), F.concat_ws("-", "doc_id", "section_number").alias("chunk_id"))
    return d.withColumnRenamed("doc_id", "turn_id"), cited, retrieved, d.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("act_number"))


@query("j8_validate_citations", """SELECT turn_id, CASE WHEN turn_id % 4 = 0 THEN 'No citation found. A legal answer must cite at least one retrieved section.' ELSE
  concat_ws('|', concat_ws('|', u, 'Citation Section  of Act ' || turn_id || ' was not in retrieved sources.'), nullif(concat_ws('|', u, CASE WHEN NOT found THEN 'Citation Section ' || n || ' of Act ' || turn_id || ' was not in retrieved sources.' END), ''), concat_ws('|', u, 'Citation Section 99 of Act ' || turn_id || ' was not in retrieved sources.')) END AS violations
FROM (SELECT doc_id AS turn_id, doc_id % 7 + 1 AS n, CASE WHEN doc_id % 3 = 0 THEN 'Citation references unknown Act ' || doc_id || '.' END AS u, EXISTS (SELECT 1 FROM v_sections c WHERE c.doc_id = documents.doc_id AND section_number = (documents.doc_id % 7 + 1)::VARCHAR) AS found FROM documents)""")
def _(v: Views) -> DataFrame:
    return lookup.validate_citations(*_turn_rows(v)).select("turn_id", F.array_join(F.filter("violations", lambda x: x != ""), "|").alias("violations"))


@query("j9_attach_citations", "SELECT turn_id, pos, turn_id || '-' || section_number AS chunk_id FROM v_citations q JOIN (SELECT doc_id, section_number AS s FROM v_sections) ON doc_id = turn_id AND pos = 0 AND s = (turn_id % 7 + 1)::VARCHAR".replace("turn_id || '-' || section_number", "turn_id || '-' || s"))
def _(v: Views) -> DataFrame:
    _, _, retrieved, _ = _turn_rows(v)
    return lookup.attach_citations(v.citations, retrieved).select("turn_id", "pos", "chunk_id")


@query("j19_resolve_alias", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'new-' || doc_id ELSE document_id END AS document_id FROM v_docs")
def _(v: Views) -> DataFrame:
    aliases = v.docs.filter("doc_id % 6 = 0").select(F.col("document_id").alias("alias"), F.concat(F.lit("new-"), "doc_id").alias("target"))
    return lookup.resolve_alias(v.docs.select("doc_id", "document_id"), aliases)


@query("j25_select_run", """SELECT doc_id AS request_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 7 <> 0 THEN 'x-' || doc_id END WHEN doc_id % 3 <> 0 THEN 'x-' || doc_id END AS extraction_id,
  CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'extraction_not_ready' END WHEN doc_id % 3 = 0 THEN 'no_active_extraction' END AS error FROM documents""")
def _(v: Views) -> DataFrame:
    asked = v.docs.select(F.col("doc_id").alias("request_id"), "document_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x-"), "doc_id")).alias("extraction_id"))
    return lookup.select_run(asked, v.runs, v.active).select("request_id", "extraction_id", "error")


@query("j27_seed_sections", "SELECT doc_id, section_number FROM v_sections WHERE section_number = (doc_id % 7 + 1)::VARCHAR")
def _(v: Views) -> DataFrame:
    return lookup.seed_sections(v.citations, v.chunks).select("doc_id", "section_number")


@query("io8_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v_sections)")
def _(v: Views) -> DataFrame:
    return readers.pending(v.table("documents").select("doc_id"), v.sections, "doc_id")


@query("t9_harvest_links", r"""SELECT page_id, p - 1 AS pos, regexp_extract(a, '(?i)\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace(a, '<[^>]+>', '', 'g')) AS label
FROM (SELECT page_id, unnest(anchors) AS a, unnest(range(1, len(anchors) + 1)) AS p FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS anchors FROM pages))""")
def _(v: Views) -> DataFrame:
    return readers.harvest_links(v.table("pages"))
