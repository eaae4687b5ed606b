"""Queries over cases, results, memory, histories and versions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import policy, values
from corpuslake.operators import batches, evals, index, lookup, memory, quality, registry, segment
from corpuslake.operators.vectors import cosines, similar_pairs
from corpuslake.plans.registry import query
from corpuslake.plans.views import Views
from corpuslake.streaming import streams


@query("a1_totals_by_type", "SELECT source AS act_type, count(*) AS acts FROM documents GROUP BY source")
def _(v: Views) -> DataFrame:
    return evals.totals_by_type(v.table("documents").select(F.col("source").alias("act_type")))


_FILES = """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'metadata_missing' WHEN doc_id % 13 = 0 THEN 'amendment_only' WHEN doc_id % 11 = 0 THEN 'corrupt_pdf' WHEN doc_id % 9 = 0 THEN 'title_missing' WHEN characters / greatest(pages, 1) < 100 THEN 'scanned_image_only'
  WHEN doc_id % 3 <> 0 AND doc_id % 7 <> 0 THEN 'verified_active_extraction' WHEN doc_id % 7 <> 0 THEN 'verified_shadow_extraction' WHEN doc_id % 2 = 0 THEN 'not_extracted' WHEN n = 0 THEN 'no_chunks' ELSE 'legacy_chunks_without_provenance' END AS reason
FROM (SELECT d.doc_id, coalesce(sum(length(p.text)), 0) AS characters, count(p.page_number) AS pages FROM documents d LEFT JOIN v_pages p USING (doc_id) GROUP BY d.doc_id) JOIN (SELECT doc_id, chunk_count - CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS n FROM v_runs) USING (doc_id)"""


def _coverage(v: Views) -> DataFrame:
    scanned = segment.scanned(v.pages, "doc_id").select("doc_id", "scanned")
    d = F.col("doc_id")
    counted = v.runs.select("doc_id", "status", (F.col("chunk_count") - F.when(d % 10 == 0, 1).otherwise(0)).alias("n"))
    files = v.table("documents").select("doc_id").join(scanned, "doc_id", "left").join(counted, "doc_id").select("doc_id", (d % 17 != 0).alias("has_metadata"), F.when(d % 13 != 0, "u").alias("source_url"), (d % 11 != 0).alias("readable"), F.when(d % 9 != 0, "t").alias("act_title"), F.coalesce("scanned", F.lit(True)).alias("scanned"), (d % 3 != 0).alias("is_active"), F.when(F.col("status") == "ready", 1).otherwise(0).alias("ready_runs"), F.when(d % 2 != 0, F.col("n")).alias("legacy_chunks"))
    return registry.classify_coverage(files)


@query("p5_coverage", f"SELECT doc_id, reason, CASE reason WHEN 'verified_active_extraction' THEN 'enabled' WHEN 'verified_shadow_extraction' THEN 'ready' ELSE 'blocked' END AS status FROM ({_FILES})")
def _(v: Views) -> DataFrame:
    return _coverage(v).select("doc_id", "reason", "status")


@query("a2_coverage_counts", f"SELECT CASE reason WHEN 'verified_active_extraction' THEN 'enabled' WHEN 'verified_shadow_extraction' THEN 'ready' ELSE 'blocked' END AS status, reason, count(*) AS files, count(*) FILTER (reason IN ('metadata_missing', 'amendment_only', 'corrupt_pdf')) AS to_download, count(*) FILTER (reason NOT IN ('metadata_missing', 'title_missing', 'verified_active_extraction', 'verified_shadow_extraction')) AS to_extract FROM ({_FILES}) GROUP BY reason")
def _(v: Views) -> DataFrame:
    return registry.coverage_counts(_coverage(v))


_SUMMARY = "SELECT CASE WHEN grouping(expected_policy) = 0 THEN 'policy' WHEN grouping(category) = 0 THEN 'category' ELSE 'scenario' END AS dimension, coalesce(expected_policy, category, scenario) AS value, count(*) AS cases, count(*) FILTER (smoke) AS smoke FROM v_cases GROUP BY GROUPING SETS ((expected_policy), (category), (scenario))"


@query("a5_coverage_summary", _SUMMARY)
def _(v: Views) -> DataFrame:
    return evals.coverage_summary(v.cases)


@query("a6_gap_flags", f"""SELECT 'thin_' || dimension AS rule, value, cases::DOUBLE AS measure FROM ({_SUMMARY}) WHERE dimension <> 'policy' AND cases < 5
UNION ALL SELECT 'no_smoke_coverage', value, 0.0 FROM ({_SUMMARY}) WHERE dimension = 'scenario' AND smoke = 0
UNION ALL SELECT 'weak_boundary_coverage', 'block', m FROM (SELECT coalesce(count(*) FILTER (expected_policy = 'block')::DOUBLE / count(*), 0) AS m FROM v_cases) WHERE m < 0.2""")
def _(v: Views) -> DataFrame:
    return evals.gap_flags(v.cases)


@query("a7_scenario_rates", "SELECT scenario, count(*) FILTER (l1_failures = 0 AND judge_passed) AS passed, count(*) AS total, count(*) FILTER (l1_failures = 0 AND judge_passed)::DOUBLE / count(*) AS rate FROM v_cases GROUP BY scenario")
def _(v: Views) -> DataFrame:
    return evals.scenario_rates(v.cases)


_ASSERTIONS = ["exists", "expected", "recall", "language", "uuid", "refusal", "tools"]


@query("a8_assertion_rates", "SELECT assertion, count(outcome) AS applicable, count(*) FILTER (outcome) AS passed, count(*) FILTER (outcome)::DOUBLE / nullif(count(outcome), 0) AS rate FROM (SELECT unnest(['exists', 'expected', 'recall', 'language', 'uuid', 'refusal', 'tools']) AS assertion, unnest([case_id % 2 = 0, CASE WHEN case_id % 3 > 0 THEN case_id % 4 > 0 END, judge_passed, NULL, true, smoke, l1_failures = 0]) AS outcome FROM v_cases) GROUP BY assertion")
def _(v: Views) -> DataFrame:
    i = F.col("case_id")
    return evals.assertion_rates(v.cases.select((i % 2 == 0).alias("exists"), F.when(i % 3 > 0, i % 4 > 0).alias("expected"), F.col("judge_passed").alias("recall"), F.lit(None).cast("boolean").alias("language"), F.lit(True).alias("uuid"), F.col("smoke").alias("refusal"), (F.col("l1_failures") == 0).alias("tools")), _ASSERTIONS)


def _recalls(v: Views) -> DataFrame:
    expected = evals.case_sections(v.cases).select("case_id", F.posexplode("sections").alias("pos", "s")).select("case_id", "pos", "s.*")
    return evals.section_recall(v.citations.withColumnRenamed("turn_id", "case_id").filter("pos = 0 OR case_id % 4 = 0").drop("pos"), expected)


@query("a9_section_recall", """SELECT case_id, 2 AS expected, 1 + CASE WHEN case_id % 4 = 0 THEN 1 ELSE 0 END AS matched, case_id || '/' || (case_id % 7 + 1) || CASE WHEN case_id % 4 = 0 THEN ',' || case_id || '/99' ELSE '' END AS matched_sections, CASE WHEN case_id % 4 = 0 THEN '' ELSE case_id || '/99' END AS missing_sections, (1 + CASE WHEN case_id % 4 = 0 THEN 1 ELSE 0 END) / 2.0::DOUBLE AS recall FROM v_cases""")
def _(v: Views) -> DataFrame:
    return _recalls(v).select("case_id", "expected", "matched", F.array_join("matched_sections", ",").alias("matched_sections"), F.array_join("missing_sections", ",").alias("missing_sections"), "recall")


@query("a10_recall_pass", "SELECT case_id, 2 AS expected, 1 + CASE WHEN case_id % 4 = 0 THEN 1 ELSE 0 END AS matched, 1 + CASE WHEN case_id % 4 = 0 THEN 1 ELSE 0 END >= greatest(0, least(min_sections_found, 2)) AS passed FROM v_cases")
def _(v: Views) -> DataFrame:
    return evals.recall_verdicts(_recalls(v), v.cases)


@query("a11_eval_summary", "SELECT avg(CASE WHEN case_id % 3 > 0 THEN (case_id % 5)::DOUBLE / 4 END) AS mean_recall, count(*) FILTER (judge_passed)::DOUBLE / count(judge_passed) AS judge_rate, 1.0::DOUBLE AS existence_rate, count(*) FILTER (judge_passed)::DOUBLE / count(judge_passed) >= 0.8 AS released FROM v_cases")
def _(v: Views) -> DataFrame:
    i = F.col("case_id")
    return evals.eval_summary(v.cases.select(F.when(i % 3 > 0, (i % 5) / 4).alias("recall"), "judge_passed", F.lit(True).alias("citations_exist")), 0.8)


@query("a19_turn_scores", f"""SELECT thread_id || '-' || pos AS turn_id, CASE WHEN pos % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS passed, CASE WHEN pos % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS num_violations, pos::DOUBLE AS retry_count, CASE WHEN pos % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS fallback_delivered, CASE WHEN regexp_matches(text, '{policy.any_phrase(policy.ESCALATION)}') THEN 1.0 ELSE 0.0 END::DOUBLE AS escalated, tokens::DOUBLE AS reference_follow_calls, 0.0::DOUBLE AS reference_fail_open FROM v_history""")
def _(v: Views) -> DataFrame:
    none = F.array().cast("array<string>")
    turns = v.history.select(F.concat_ws("-", "thread_id", "pos").alias("turn_id"), F.when(F.col("pos") % 3 == 0, F.array(F.lit("x"))).otherwise(none).alias("violations"), none.alias("evidence_violations"), none.alias("citations"), F.col("pos").alias("retry_count"), F.col("text").alias("final"), F.lit("").alias("draft"), F.when(policy.is_escalation(F.col("text")), "escalate").otherwise("research").alias("query_type"), F.create_map(F.lit("calls"), F.col("tokens")).alias("reference_metrics"))
    return evals.turn_scores(turns).select("turn_id", "passed", "num_violations", "retry_count", "fallback_delivered", "escalated", "reference_follow_calls", "reference_fail_open")


@query("a21_present_pairs", "SELECT DISTINCT act_number, upper(section_number) AS section_number FROM v_chunks")
def _(v: Views) -> DataFrame:
    return evals.present_pairs(v.chunks)


@query("p12_select_cases", "SELECT case_id FROM v_cases WHERE smoke")
def _(v: Views) -> DataFrame:
    return evals.select_cases(v.cases, "smoke").select("case_id")


@query("p13_eligible", "SELECT doc_id FROM v_docs WHERE doc_id % 7 <> 0 AND coalesce(act_title, '') <> ''")
def _(v: Views) -> DataFrame:
    return registry.eligible(v.docs).select("doc_id")


@query("p15_verdict", "SELECT case_id, CASE WHEN l1_failures > 0 THEN 'L1_FAIL' WHEN case_id % 5 = 0 THEN 'SKIP' WHEN CASE WHEN case_id % 2 = 0 THEN judge_passed ELSE case_id % 3 > 0 END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v_cases")
def _(v: Views) -> DataFrame:
    i = F.col("case_id")
    rows = v.cases.select("case_id", "l1_failures", (i % 5 != 0).alias("judged"), F.when(i % 2 == 0, F.col("judge_passed")).alias("judge_passed"), F.when(i % 3 == 0, False).alias("citation_accuracy"), F.lit(None).cast("boolean").alias("policy_compliance"))
    return evals.verdicts(rows).select("case_id", "verdict")


@query("p16_flatten_results", "SELECT case_id, category, scenario, judge_passed, 'c' AS critique, l1_failures, array_to_string(list_transform(range(0, least(8, case_id % 12)), lambda x: case_id || '/' || x), ',') AS retrieved FROM v_cases")
def _(v: Views) -> DataFrame:
    at = F.when(F.col("case_id") % 12 > 0, F.sequence(F.lit(0).cast("long"), F.col("case_id") % 12 - 1)).otherwise(F.array().cast("array<bigint>"))
    nested = v.cases.select("case_id", "category", "scenario", F.struct(F.col("judge_passed").alias("passed"), F.lit("c").alias("critique")).alias("judge"), F.when(F.col("l1_failures") > 0, F.array(F.lit("toxic"))).alias("failures"), F.transform(at, lambda i: F.struct(F.col("id").alias("act_number"), i.cast("string").alias("section_number"))).alias("retrieved"))
    return evals.flatten_results(nested).withColumn("retrieved", F.array_join("retrieved", ","))


@query("x6_case_sections", "SELECT case_id, case_id || '/' || (case_id % 7 + 1) || ',' || case_id || '/99' AS sections FROM v_cases")
def _(v: Views) -> DataFrame:
    return evals.case_sections(v.cases).select("case_id", F.array_join(F.transform("sections", lambda s: F.concat(s["act_number"], F.lit("/"), s["section_number"])), ",").alias("sections"))


_REQUIRED = "SELECT case_id, unnest([(case_id % 7 + 1)::VARCHAR, '99']) AS section_number FROM v_cases WHERE citation_applicable"


@query("x2_required_not_present", f"SELECT DISTINCT case_id::VARCHAR AS act_number, section_number FROM ({_REQUIRED}) r WHERE NOT EXISTS (SELECT 1 FROM v_sections s WHERE s.doc_id = r.case_id AND s.section_number = r.section_number)")
def _(v: Views) -> DataFrame:
    return lookup.missing_sections(evals.required_pairs(v.cases), v.chunks)


@query("x2_required_pairs", f"SELECT case_id::VARCHAR AS act_number, section_number FROM ({_REQUIRED})")
def _(v: Views) -> DataFrame:
    return evals.required_pairs(v.cases)


@query("j28_review_sheet", r"""SELECT case_id, case_id || '/' || (case_id % 7 + 1) || ': ' || coalesce((SELECT CASE WHEN length(flat) <= 60 THEN flat ELSE regexp_replace(left(flat, 59), '\s+$', '') || '…' END FROM (SELECT trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat FROM v_sections s WHERE s.doc_id = case_id AND section_number = (case_id % 7 + 1)::VARCHAR)), 'MISSING SECTION') || ' | ' || case_id || '/99: MISSING SECTION' AS sheet FROM v_cases""")
def _(v: Views) -> DataFrame:
    return evals.review_sheet(v.cases, v.chunks, 60).select("case_id", F.array_join("sections", " | ").alias("sheet"))


@query("x3_tool_checks", """SELECT case_id, case_id % 2 = 0 AS has_tool, case_id % 2 = 0 AS in_order, CASE WHEN case_id % 2 = 0 THEN 'follow' ELSE '' END AS forbidden, true AS capped FROM v_cases""")
def _(v: Views) -> DataFrame:
    trace = F.when(F.col("case_id") % 2 == 0, F.array(F.lit("exact"), F.lit("semantic"), F.lit("follow"))).otherwise(F.array(F.lit("semantic"), F.lit("exact")))
    rows = v.cases.select("case_id", trace.alias("tool_trace"), F.when(F.col("case_id") % 2 == 0, "semantic").otherwise("follow").alias("expected_tool"), F.array(F.lit("exact"), F.lit("semantic")).alias("expected_sequence"), F.array(F.lit("follow"), F.lit("none")).alias("forbidden_tools"), F.create_map(F.lit("exact"), F.lit(1)).alias("max_calls"))
    return evals.tool_checks(rows).withColumn("forbidden", F.array_join("forbidden", ","))


_TURNS = "SELECT thread_id, pos, role, text, tokens, ((p - CASE WHEN r = 'user' THEN 0 ELSE 1 END) // 2)::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos) - 1 AS p, first(role) OVER (PARTITION BY thread_id ORDER BY pos) AS r FROM v_history) WHERE p - CASE WHEN r = 'user' THEN 0 ELSE 1 END >= 0"
_SUMMED = f"SELECT *, sum(tokens) OVER (PARTITION BY thread_id ORDER BY turn DESC RANGE UNBOUNDED PRECEDING) AS upto, max(turn) OVER (PARTITION BY thread_id) AS last FROM ({_TURNS})"


@query("w6_trim_history", f"SELECT thread_id, pos, turn, tokens FROM ({_SUMMED}) WHERE upto <= 120 OR turn = last")
def _(v: Views) -> DataFrame:
    return memory.trim_history(v.history, 120).select("thread_id", "pos", "turn", "tokens")


@query("w14_trim_sweep", f"SELECT thread_id, budget, sum(tokens)::BIGINT AS kept_tokens, count(DISTINCT turn) AS kept_turns, bool_or(contains(text, 'the')) AS survives FROM ({_SUMMED}), (SELECT unnest([60, 120, 240]) AS budget) WHERE upto <= budget OR turn = last GROUP BY thread_id, budget")
def _(v: Views) -> DataFrame:
    return memory.trim_sweep(v.history, [60, 120, 240], "the")


def _timeline(v: Views) -> DataFrame:
    o = F.col("o_orderkey")
    date = F.when(o % 11 == 0, "31/02/2020").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return v.table("orders").select(F.col("o_custkey").cast("string").alias("act_number"), o.alias("pos"), date.alias("date"), F.when(o % 3 == 0, "REPRINT").when(o % 3 == 1, "AMENDMENTS").otherwise("REPRINT ONLINE").alias("log_type"), F.when(o % 5 > 0, F.concat(F.lit("u"), o)).alias("pdf_url"))


_TIMELINE = "SELECT o_custkey::VARCHAR AS act_number, o_orderkey AS pos, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS date, CASE o_orderkey % 3 WHEN 0 THEN 'REPRINT' WHEN 1 THEN 'AMENDMENTS' ELSE 'REPRINT ONLINE' END AS log_type, CASE WHEN o_orderkey % 5 > 0 THEN 'u' || o_orderkey END AS pdf_url FROM orders"


@query("w7_latest_reprint", f"SELECT act_number, pdf_url AS reprint_url FROM (SELECT *, row_number() OVER (PARTITION BY act_number ORDER BY date DESC, pos) AS n FROM ({_TIMELINE}) WHERE log_type <> 'AMENDMENTS' AND pdf_url IS NOT NULL AND date IS NOT NULL) WHERE n = 1")
def _(v: Views) -> DataFrame:
    return registry.latest_reprint(_timeline(v))


@query("w8_latest_amendment", f"SELECT act_number, max_by(pdf_url, pos) AS amendment_url FROM ({_TIMELINE}) WHERE log_type = 'AMENDMENTS' AND pdf_url IS NOT NULL GROUP BY act_number")
def _(v: Views) -> DataFrame:
    return registry.latest_amendment(_timeline(v))


@query("w9_with_previous", "SELECT act_number, event_id, extraction_id, lag(extraction_id) OVER (PARTITION BY act_number ORDER BY ts, event_id) AS previous_id FROM v_log WHERE action = 'activate'")
def _(v: Views) -> DataFrame:
    log = v.log.filter("action = 'activate'").withColumn("seq", F.struct("at", "event_id"))
    return registry.with_previous(log).select("act_number", "event_id", "extraction_id", "previous_id")


@query("st3_activation_state", """WITH RECURSIVE numbered AS (SELECT act_number, language, action, extraction_id, row_number() OVER (PARTITION BY act_number ORDER BY ts, event_id) AS seq FROM v_log), state AS (
  SELECT act_number, language, 0::BIGINT AS seq, '' AS action, NULL::VARCHAR AS now, NULL::VARCHAR AS before, false AS changed FROM numbered WHERE seq = 1
  UNION ALL SELECT n.act_number, n.language, n.seq, n.action, CASE WHEN n.action = 'activate' THEN n.extraction_id WHEN before IS NOT NULL THEN before ELSE now END, CASE WHEN n.action = 'activate' THEN coalesce(now, before) WHEN before IS NOT NULL THEN now ELSE before END, n.action = 'activate' OR before IS NOT NULL
  FROM state s JOIN numbered n ON n.act_number = s.act_number AND n.seq = s.seq + 1) SELECT act_number, language, seq, action, now AS extraction_id, before AS previous_id FROM state WHERE changed""")
def _(v: Views) -> DataFrame:
    ordered = v.log.withColumn("seq", F.row_number().over(Window.partitionBy("act_number").orderBy("at", "event_id")).cast("long"))
    return registry.activation_state(ordered)


# Threads of one answer have no turn.
@query("st4_history", f"""SELECT thread_id, coalesce(kept_messages, 0)::INT AS kept_messages, coalesce(kept_tokens, 0)::BIGINT AS kept_tokens, coalesce(last_pos, -1)::INT AS last_pos FROM (SELECT DISTINCT thread_id FROM v_history)
  LEFT JOIN (SELECT thread_id, count(*) AS kept_messages, sum(tokens) AS kept_tokens, max(pos) AS last_pos FROM ({_SUMMED}) WHERE upto <= 120 OR turn = last GROUP BY thread_id) USING (thread_id)""")
def _(v: Views) -> DataFrame:
    streams.keep_state_in_rocksdb(v.spark)
    return streams.stream_history(v.history.select("thread_id", "pos", "role", "tokens"), 120)


@query("st5_counts", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return streams.counts(v.table("events")).withColumn("start", F.unix_micros(F.col("start").cast("timestamp")))


# Of the events of a user, kind and minute those with ids that 3 divides are stored; the parity of an id is its timeline.
_SEEN = "SELECT user_id::VARCHAR AS document_id, event_type AS source_url, epoch_us(date_trunc('minute', ts)) AS minute, (event_id % 2)::VARCHAR AS kind, event_id % 3 = 0 AS stored FROM events"
_MET = f"""SELECT *, CASE WHEN old IS NULL THEN min(kind) OVER (PARTITION BY document_id, source_url, minute) ELSE old END AS kept FROM (SELECT DISTINCT document_id, source_url, minute, kind FROM ({_SEEN}) WHERE NOT stored)
  LEFT JOIN (SELECT document_id, source_url, minute, min(kind) AS old FROM ({_SEEN}) WHERE stored GROUP BY ALL) USING (document_id, source_url, minute)"""


@query("st1_observations", f"SELECT document_id, source_url, minute, kept AS kind, 'new' AS part FROM ({_MET}) WHERE old IS NULL GROUP BY ALL UNION ALL SELECT document_id, source_url, minute, kind, 'conflict' FROM ({_MET}) WHERE kind <> kept")
def _(v: Views) -> DataFrame:
    e = v.table("events")
    rows = e.select("event_id", F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("source_url"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("observed_at"), F.lit("x").alias("timeline_date"), (F.col("event_id") % 2).cast("string").alias("timeline_type"))
    stored = rows.filter("event_id % 3 = 0").groupBy(*streams.SEEN, "timeline_date").agg(F.min("timeline_type").alias("timeline_type"))
    new, clash = streams.taken_in(rows.filter("event_id % 3 <> 0"), stored)
    out = lambda df, part: df.select("document_id", "source_url", F.unix_micros("observed_at").alias("minute"), F.col("timeline_type").alias("kind"), F.lit(part).alias("part"))
    return out(new, "new").unionByName(out(clash, "conflict"))


# Documents are bundles of their sections; a third has a wrong count, the even ones are stored, some of these with other chunks.
@query("st2_bundles", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 8 <> 0 THEN 'stored' WHEN doc_id % 2 = 0 THEN 'conflict' WHEN doc_id % 3 = 0 THEN 'invalid' ELSE 'write' END AS outcome, count(*) AS chunks FROM v_sections GROUP BY doc_id""")
def _(v: Views) -> DataFrame:
    d = F.col("doc_id")
    chunk = F.struct("chunk_ordinal", "content", "content_sha256", F.concat(F.lit("x-"), d).alias("extraction_id"), F.concat(F.lit("d"), d).alias("document_id"))
    listed = v.sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    count = F.size("chunks") + F.when(d % 3 == 0, 1).otherwise(0)
    bundles = listed.select(F.struct(F.concat(F.lit("x-"), d).alias("extraction_id"), F.concat(F.lit("d"), d).alias("document_id"), d.alias("doc_id"), count.alias("chunk_count")).alias("extraction"), "chunks")
    none = v.table("documents").select(F.lit("").alias("extraction_id"), F.lit("").alias("mark")).limit(0)
    marks = streams.checked_bundles(bundles, none).filter("doc_id % 2 = 0").select("extraction_id", F.when(d % 8 == 0, "other").otherwise(F.col("mark")).alias("mark"))
    return streams.checked_bundles(bundles, marks).select("doc_id", "outcome", F.size("chunks").cast("long").alias("chunks"))


@query("w10_dedupe_hits", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return memory.dedupe_hits(v.table("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("w11_admit_within_budget", "SELECT doc_id, running FROM (SELECT doc_id, sum(byte_size) OVER (ORDER BY doc_id)::BIGINT AS running FROM v_docs) WHERE running <= 500000")
def _(v: Views) -> DataFrame:
    return registry.admit_within_budget(v.docs.select("doc_id", "byte_size"), "byte_size", 500_000).select("doc_id", "running")


@query("w12_assign_batches", "SELECT doc_id, section_number, chunk_ordinal // 3 AS batch FROM v_sections")
def _(v: Views) -> DataFrame:
    return batches.assign_batches(v.sections, 3, "doc_id").select("doc_id", "section_number", "batch")


@query("u2_pack_batches", """WITH RECURSIVE sized AS (SELECT doc_id, chunk_ordinal, length(content)::BIGINT AS tokens FROM v_sections), packed AS (
  SELECT doc_id, chunk_ordinal, tokens, 0 AS batch, 1 AS held_rows, tokens AS held FROM sized WHERE chunk_ordinal = 0
  UNION ALL SELECT s.doc_id, s.chunk_ordinal, s.tokens, CASE WHEN held_rows >= 4 OR held + s.tokens > 1500 THEN batch + 1 ELSE batch END, CASE WHEN held_rows >= 4 OR held + s.tokens > 1500 THEN 1 ELSE held_rows + 1 END, CASE WHEN held_rows >= 4 OR held + s.tokens > 1500 THEN s.tokens ELSE held + s.tokens END
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.chunk_ordinal = p.chunk_ordinal + 1) SELECT doc_id, chunk_ordinal, tokens, batch FROM packed""")
def _(v: Views) -> DataFrame:
    return batches.pack_batches(v.sections.withColumn("tokens", F.length("content").cast("long")), 4, 1500, "doc_id")


@query("w13_split_long", "SELECT doc_id, i AS segment, least(50, len(tokens) - i * 50)::INT AS weight, tokens[i * 50 + 1] AS first_token FROM (SELECT doc_id, tokens, unnest(range(0, (len(tokens) + 49) // 50)) AS i FROM v_doc_tokens)")
def _(v: Views) -> DataFrame:
    rows = v.table("documents").select("doc_id", values.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return registry.split_long(rows, 50).select("doc_id", "segment", "weight", F.get("part", F.lit(0)).alias("first_token"))


@query("w15_preferred_mapping", "SELECT act_number, language, extraction_id FROM (SELECT *, row_number() OVER (PARTITION BY act_number ORDER BY language <> 'en', language) AS n FROM (SELECT (doc_id % 100)::VARCHAR AS act_number, language, min(extraction_id) AS extraction_id FROM v_active GROUP BY ALL)) WHERE n = 1")
def _(v: Views) -> DataFrame:
    a = v.active.groupBy((F.col("doc_id") % 100).cast("string").alias("act_number"), "language").agg(F.min("extraction_id").alias("extraction_id"))
    return registry.preferred_mapping(a)


@query("j5_ready_extractions", "SELECT doc_id, chunk_count FROM v_runs WHERE status = 'ready' AND doc_id % 5 <> 0 AND chunk_count > 0")
def _(v: Views) -> DataFrame:
    return registry.ready_extractions(v.runs, v.chunks).select("doc_id", "chunk_count")


_PLAN = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'prepare' WHEN doc_id % 5 = 0 OR chunk_count = 0 THEN 'ingest' WHEN doc_id % 3 = 0 THEN 'activate' ELSE 'done' END AS step FROM v_runs"""


@query("a22_rollout_plan", f"SELECT document_id, step FROM ({_PLAN}) JOIN v_docs USING (doc_id)")
def _(v: Views) -> DataFrame:
    return registry.rollout_plan(v.docs, v.runs, v.chunks, v.active).select("document_id", "step")


_RIVALS = """SELECT document_id, CASE WHEN status <> 'ready' THEN 'prepare' WHEN act % 3 = 0 AND doc_id <> 2 * act THEN 'superseded' WHEN act % 3 <> 0 AND several > 1 THEN 'ambiguous' WHEN NOT whole THEN 'ingest' WHEN act % 3 = 0 THEN 'done' ELSE 'activate' END AS step
FROM (SELECT *, doc_id // 2 AS act, count(*) FILTER (status = 'ready') OVER (PARTITION BY doc_id // 2) AS several, doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM v_sections) AS whole FROM v_runs)"""
_STEPS = ("ambiguous", "superseded", "prepare", "ingest", "activate", "done")


def _rivals(v: Views) -> DataFrame:
    """Two documents an act, both with a run of their own; every third act has an active mapping, to the first of them."""
    act = F.floor(F.col("doc_id") / 2)
    docs = v.docs.select("document_id", act.cast("string").alias("act_number"), F.lit("en").alias("language"))
    active = v.docs.filter((F.col("doc_id") % 2 == 0) & (act % 3 == 0))
    active = active.select(act.cast("string").alias("act_number"), F.lit("en").alias("language"), "document_id", F.concat(F.lit("x-"), "doc_id").alias("extraction_id"))
    return registry.rollout_plan(docs, v.runs, v.chunks, active)


@query("a22_rivals", f"SELECT document_id, step, CASE step WHEN 'ambiguous' THEN 'several ready versions and no active mapping' WHEN 'prepare' THEN 'no ready extraction' END AS failure FROM ({_RIVALS})")
def _(v: Views) -> DataFrame:
    return _rivals(v)


@query("a22_rival_counts", "SELECT count(*) AS candidates, " + ", ".join(f"count(*) FILTER (step = '{s}') AS {s}" for s in _STEPS) + f" FROM ({_RIVALS})")
def _(v: Views) -> DataFrame:
    return registry.rollout_counts(_rivals(v))


@query("a22_rollout_counts", f"SELECT count(*) AS candidates, 0::BIGINT AS ambiguous, 0::BIGINT AS superseded, count(*) FILTER (step = 'prepare') AS prepare, count(*) FILTER (step = 'ingest') AS ingest, count(*) FILTER (step = 'activate') AS activate, count(*) FILTER (step = 'done') AS done FROM ({_PLAN})")
def _(v: Views) -> DataFrame:
    return registry.rollout_counts(registry.rollout_plan(v.docs, v.runs, v.chunks, v.active))


@query("a20_embedding_cost", "SELECT sum(len(tokens))::BIGINT AS tokens, (sum(len(tokens)) * 0.02::DECIMAL(12,6) / 1000000)::DOUBLE AS cost_usd, 50000::BIGINT AS token_limit, sum(len(tokens)) <= 50000 AS affordable FROM v_doc_tokens".replace("(sum(len(tokens)) * 0.02::DECIMAL(12,6) / 1000000)::DOUBLE", "round(sum(len(tokens)) * 0.02 / 1000000, 6)::DOUBLE"))
def _(v: Views) -> DataFrame:
    counted = v.table("documents").select(F.size(values.tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    return registry.embedding_cost(counted, Decimal("0.02"), Decimal("0.001")).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("x5_carry_superseded", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'superseded' ELSE 'registered' END AS lifecycle_status FROM documents")
def _(v: Views) -> DataFrame:
    d = v.docs.select("doc_id", "document_id", "lifecycle_status")
    return registry.carry_superseded(d.filter("doc_id % 4 <> 0"), d.filter("doc_id % 2 = 0")).select("doc_id", "lifecycle_status")


_UPSERT = "SELECT document_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 THEN 'xx' ELSE language END AS language, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN act_title WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 2 = 0 THEN act_title END AS act_title, doc_id FROM v_docs"


@query("j23_upsert", f"SELECT document_id, language, act_title, 'stored' AS part FROM ({_UPSERT}) WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 UNION ALL SELECT document_id, 'xx', NULL, 'conflict' FROM v_docs WHERE doc_id % 6 = 0")
def _(v: Views) -> DataFrame:
    d = v.docs.select("doc_id", "document_id", "language", "act_title")
    old = d.filter("doc_id % 2 = 0").drop("doc_id")
    new = d.filter("doc_id % 3 = 0").select("document_id", F.lit("xx").alias("language"), F.lit("new").alias("act_title"))
    table, conflicts = registry.upsert_immutable(old, new, "document_id", ["language"], ["act_title"])
    clash = conflicts.select("document_id", "language", F.lit(None).cast("string").alias("act_title"), F.lit("conflict").alias("part"))
    return table.select("document_id", "language", "act_title", F.lit("stored").alias("part")).unionByName(clash)


@query("io9_migrate_manifest", "SELECT 'old-' || doc_id AS alias, document_id AS target, act_number FROM v_docs")
def _(v: Views) -> DataFrame:
    old = v.docs.select(F.concat(F.lit("old-"), "doc_id").alias("document_id"), "act_number", "language", "sha256")
    documents, aliases = registry.migrate_manifest(old)
    return aliases.join(documents.select(F.col("document_id").alias("target"), "act_number"), "target")


@query("k8_versions", "SELECT document_id, language FROM v_docs WHERE act_title = 'src3'")
def _(v: Views) -> DataFrame:
    d = v.docs.select("document_id", "language", F.col("act_title").alias("act_number"))
    return registry.versions_for_act(d, "src3").select("document_id", "language")


@query("k5_order_snapshots", f"SELECT act_number, pos, date::DATE::VARCHAR AS parsed_date FROM ({_TIMELINE})")
def _(v: Views) -> DataFrame:
    return registry.order_snapshots(_timeline(v).withColumn("snapshot_id", F.col("pos"))).select("act_number", "pos", F.col("parsed_date").cast("string").alias("parsed_date"))


@query("j17_snapshot_catalog", f"SELECT act_number, pdf_url AS source_url, CASE WHEN pos % 2 = 0 AND pdf_url IS NOT NULL THEN 'd' || pos END AS document_id, CASE WHEN pos % 2 = 0 AND pdf_url IS NOT NULL THEN CASE WHEN pos % 4 = 0 THEN 'a' || pos ELSE 'd' || pos END END AS snapshot_id FROM ({_TIMELINE}) WHERE log_type <> 'AMENDMENTS'")
def _(v: Views) -> DataFrame:
    t = _timeline(v)
    docs = t.filter("pos % 2 = 0 AND pdf_url IS NOT NULL").select("act_number", F.col("pdf_url").alias("source_url"), F.concat(F.lit("d"), "pos").alias("document_id"), "pos")
    aliases = docs.filter("pos % 4 = 0").select(F.explode(F.array(F.concat(F.lit("a"), "pos"), F.concat(F.lit("b"), "pos"))).alias("alias"), F.col("document_id").alias("target"))
    return registry.snapshot_catalog(t, docs.drop("pos"), aliases).select("act_number", "source_url", "document_id", "snapshot_id")


@query("p17_snapshot_readiness", f"SELECT pos, CASE WHEN pos % 2 = 0 THEN 'ready' WHEN pos % 3 = 0 THEN 'blocked' WHEN pos % 5 = 0 THEN 'scanned_unparseable' ELSE 'ready' END AS readiness, CASE WHEN pos % 2 = 0 THEN 'already_registered' WHEN pos % 9 = 0 THEN 'not_fetched' WHEN pos % 3 = 0 THEN 'corrupt_pdf' WHEN pos % 5 = 0 THEN 'scanned_image_only' ELSE 'text_layer' END AS why FROM ({_TIMELINE})")
def _(v: Views) -> DataFrame:
    p = F.col("pos")
    t = _timeline(v).select("pos", F.concat(F.lit("u"), p).alias("source_url"), F.when(p % 2 == 0, F.concat(F.lit("d"), p)).alias("document_id"))
    facts = t.filter("pos % 9 <> 0").select("source_url", (p % 3 != 0).alias("readable"), (p % 5 == 0).alias("scanned"))
    return registry.snapshot_readiness(t, facts).select("pos", "readiness", "why")


@query("a15_recall_hits", "SELECT user_id, event_type AS key, count(*) AS recall_count, epoch_us(max(ts)) AS last_recalled FROM events WHERE event_type = 'view' GROUP BY ALL")
def _(v: Views) -> DataFrame:
    e = v.table("events").filter("event_type = 'view'").select("user_id", F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return memory.recall_hits(e).withColumn("last_recalled", F.unix_micros("last_recalled"))


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query("v1_cosine", f"SELECT query_id, key, round({_cos('embedding', 'query_vec')}, 6) AS similarity FROM v_memory, v_asked")
def _(v: Views) -> DataFrame:
    """Every question with every vector: the whole product, which grows with the square of the table."""
    return cosines(v.memory, v.asked_vectors, "key").withColumn("similarity", F.round("similarity", 6))


@query("k1_semantic_search", f"SELECT query_id, key AS vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM (SELECT query_id, key, {_cos('embedding', 'query_vec')} AS s FROM v_memory, v_asked)) WHERE rank <= 8")
def _(v: Views) -> DataFrame:
    from corpuslake.operators.lookup import semantic_search

    return semantic_search(v.table("embeddings"), v.asked_vectors).withColumn("similarity", F.round("similarity", 6))


@query("v2_approx_neighbors", f"SELECT query_id, key AS vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM (SELECT query_id, key, {_cos('embedding', 'query_vec')} AS s FROM v_memory, v_asked)) WHERE rank <= 8")
def _(v: Views) -> DataFrame:
    found = index.VectorIndex.fit(v.table("embeddings")).search(v.asked_vectors, 8)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


_SIMILAR = f"""SELECT a.user_id, a.key AS a, b.key AS b, {_cos('a.embedding', 'b.embedding')} AS s FROM (SELECT user_id, embedding, min(key) AS key FROM v_near GROUP BY ALL) a
  JOIN (SELECT user_id, embedding, min(key) AS key FROM v_near GROUP BY ALL) b ON a.user_id = b.user_id AND a.key < b.key"""


@query("j22_similar_pairs", f"SELECT user_id, a, b, round(s, 6) AS similarity FROM ({_SIMILAR}) WHERE s >= 0.88")
def _(v: Views) -> DataFrame:
    return similar_pairs(v.near_memory, memory.SIMILAR).withColumn("similarity", F.round("similarity", 6))


@query("j22_classes", "SELECT user_id, key, min(key) OVER (PARTITION BY user_id, embedding) AS rep FROM v_near")
def _(v: Views) -> DataFrame:
    return memory.classes(v.near_memory)


# Planted neighbours that are similar to their vector have it as their seed; all others are seeds.
@query("j22_clusters", "SELECT user_id, key, seed FROM v_near")
def _(v: Views) -> DataFrame:
    return memory.clusters(v.near_memory)


@query("k6_recall", f"""SELECT query_id, key, 0 AS part, rank FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, key) AS rank FROM v_memory JOIN v_asked USING (user_id) WHERE kind = 'profile') WHERE rank <= 5
UNION ALL SELECT query_id, key, 1, rank FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY {_cos('embedding', 'query_vec')} DESC, key) AS rank FROM v_memory JOIN v_asked USING (user_id) WHERE kind = 'topic') WHERE rank <= 5""")
def _(v: Views) -> DataFrame:
    return memory.recall(v.memory, v.asked_vectors)


_SCORE = "power(0.5::DOUBLE, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_at)) / 86400e6) / 30.0) + 2.0 * recall_count"


@query("k7_prune", f"""SELECT user_id, key, round(score, 6) AS score, CASE WHEN n <= 40 AND profiles <= 1 THEN 'kept' WHEN kind = 'profile' THEN CASE WHEN age = 1 THEN 'kept' ELSE 'merged' END WHEN best > 1 THEN 'duplicate'
  WHEN row_number() OVER (PARTITION BY user_id, kind, best = 1 ORDER BY score DESC, key) <= 30 THEN 'kept' ELSE 'evicted' END AS outcome
FROM (SELECT *, {_SCORE} AS score, count(*) OVER (PARTITION BY user_id) AS n, count(*) FILTER (kind = 'profile') OVER (PARTITION BY user_id) AS profiles, row_number() OVER (PARTITION BY user_id, kind ORDER BY updated_at DESC, key) AS age,
  row_number() OVER (PARTITION BY user_id, kind, seed ORDER BY recall_count DESC, updated_at DESC, key) AS best FROM v_near)""")
def _(v: Views) -> DataFrame:
    return memory.prune(v.near_memory, F.lit("2024-02-01").cast("timestamp")).withColumn("score", F.round("score", 6))


@query("a14_merge_profiles", """SELECT m.user_id, count(*) AS profiles, max_by(background, CASE WHEN background <> '' THEN key END) AS background, (SELECT string_agg(x, ',' ORDER BY k DESC) FROM (SELECT x, max(key) AS k FROM (SELECT user_id, key, 'a' || key % 4 AS x FROM v_memory) q WHERE q.user_id = m.user_id GROUP BY x)) AS areas
FROM (SELECT user_id, key, CASE WHEN key % 3 = 0 THEN 'b' || key ELSE '' END AS background FROM v_memory) m GROUP BY m.user_id""".replace("max_by(background, CASE WHEN background <> '' THEN key END)", "max_by(background, key) FILTER (background <> '')"))
def _(v: Views) -> DataFrame:
    items = v.memory.select("user_id", "key", "updated_at", F.when(F.col("key") % 3 == 0, F.concat(F.lit("b"), "key")).otherwise("").alias("background"), F.array(F.concat(F.lit("a"), F.col("key") % 4)).alias("areas"))
    return memory.merge_profiles(items, ["background"], ["areas"]).withColumn("areas", F.array_join("areas", ","))


@query("a13_pool_embeddings", """SELECT chunk_id, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)), 6) AS x FROM (SELECT key // 5 AS chunk_id, place, sum(e * (key % 5 + 1)) / sum(key % 5 + 1) AS x FROM (SELECT key, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS place FROM v_memory) GROUP BY ALL)""")
def _(v: Views) -> DataFrame:
    parts = v.memory.select(F.floor(F.col("key") / 5).alias("chunk_id"), (F.col("key") % 5 + 1).alias("weight"), "embedding")
    return memory.pool_embeddings(parts).select("chunk_id", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.round("x", 6))


@query("q5_fingerprint", "SELECT count(*) AS rows, true AS equal FROM v_sections")
def _(v: Views) -> DataFrame:
    """The sections, built twice, from lines dealt out differently."""
    again = segment.chunk_sections(v.lines.repartition("pos", "doc_id"), key="doc_id")
    return quality.same_content(v.sections, again)


@query("x4_same_ids", "SELECT (SELECT count(*) FROM v_sections) = (SELECT count(*) FROM v_edges) AS equal")
def _(v: Views) -> DataFrame:
    a = v.sections.select(F.concat(F.lit("e"), "doc_id", F.lit("-"), "section_number").alias("edge_id"))
    return quality.same_ids(a, v.edges, "edge_id")


@query("q4_contract", "SELECT 'enum:lang' AS code, doc_id::VARCHAR AS subject FROM documents WHERE lang NOT IN ('en', 'fr') UNION ALL SELECT 'const:source', doc_id::VARCHAR FROM documents WHERE source <> 'src0' UNION ALL SELECT 'required:text', doc_id::VARCHAR FROM documents WHERE text IS NULL")
def _(v: Views) -> DataFrame:
    return quality.validate_contract(v.table("documents"), "doc_id", ("text",), {"source": "src0"}, {"lang": ("en", "fr")})


@query("q3_registry", """SELECT 'extraction_orphan' AS code, extraction_id AS subject FROM v_runs WHERE doc_id % 50 = 0 UNION ALL SELECT 'active_not_ready', extraction_id FROM v_active WHERE doc_id % 7 = 0 UNION ALL SELECT 'alias_target', 'a' || doc_id FROM v_docs WHERE doc_id % 50 = 0 UNION ALL SELECT 'document_id_mismatch', document_id FROM v_docs WHERE doc_id % 20 = 1""")
def _(v: Views) -> DataFrame:
    docs = v.docs.filter("doc_id % 50 <> 0").withColumn("act_number", F.when(F.col("doc_id") % 20 == 1, "other").otherwise(F.col("act_number")))
    aliases = v.docs.select(F.concat(F.lit("a"), "doc_id").alias("alias"), F.col("document_id").alias("target"))
    return quality.validate_registry(docs, v.runs, v.active, aliases)


@query("q1_bundles", """SELECT 'chunk_count_mismatch' AS code, extraction_id AS subject FROM v_runs WHERE chunk_count <> CASE WHEN doc_id % 5 = 0 THEN 0 ELSE chunk_count - CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END END
UNION ALL SELECT 'chunk_hash_mismatch', extraction_id || '/' || section_number FROM v_chunks WHERE extraction_id IS NOT NULL AND doc_id % 31 = 1
UNION ALL SELECT DISTINCT 'chunk_set_hash_mismatch', extraction_id FROM v_chunks WHERE extraction_id IS NOT NULL AND doc_id % 31 = 1""")
def _(v: Views) -> DataFrame:
    broken = F.col("doc_id") % 31 == 1
    chunks = v.chunks.withColumn("content_sha256", F.when(broken, F.lit("0")).otherwise(F.col("content_sha256")))
    declared = segment.chunk_set_hash(v.chunks.filter("extraction_id IS NOT NULL"), "extraction_id")
    runs = v.runs.drop("doc_id").join(declared, "extraction_id", "left")
    return quality.validate_bundles(chunks, v.docs, runs)
