"""Evaluation cases and results: coverage, pass rates, recall, verdicts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import policy
from corpuslake.functions.keys import canonical_act, canonical_section
from corpuslake.functions.values import recall_pass, snippet

THIN, BOUNDARY_SHARE = 5, 0.20


def pair(act: Column, section: Column) -> Column:
    """Struct of canonical identifiers, or null if either is empty."""
    a, s = canonical_act(act), canonical_section(section)
    return F.when((a != "") & (s != ""), F.struct(a.alias("act_number"), s.alias("section_number")))


def case_sections(cases: DataFrame) -> DataFrame:
    """``cases`` with ``sections``: what a case expects, the scalar pair first, each once."""
    listed = F.transform(F.coalesce("expected_sections", F.array().cast("array<struct<act_number:string,section_number:string>>")), lambda x: pair(x["act_number"], x["section_number"]))
    return cases.withColumn("sections", F.array_distinct(F.array_compact(F.concat(F.array(pair(F.col("expected_act_number"), F.col("expected_section"))), listed))))


def required_pairs(cases: DataFrame) -> DataFrame:
    return case_sections(cases.filter("citation_applicable")).select(F.explode("sections").alias("s")).select("s.*").distinct()


def select_cases(cases: DataFrame, subset: str | dict[str, str]) -> DataFrame:
    """all, smoke, or {category | scenario | case_id: value}; a subset without cases is an error."""
    if subset == "all":
        out = cases
    elif subset == "smoke":
        out = cases.filter("smoke")
    elif isinstance(subset, dict) and len(subset) == 1 and (field := {"category": "category", "scenario": "scenario", "case_id": "id"}.get(next(iter(subset)))) and next(iter(subset.values())):
        out = cases.filter(F.col(field) == next(iter(subset.values())))
    else:
        raise ValueError(f"no such subset: {subset!r}")
    if out.isEmpty():
        raise ValueError(f"no cases in subset {subset!r}")
    return out


def coverage_summary(cases: DataFrame) -> DataFrame:
    """dimension, value, cases, smoke: counts by policy, category and scenario in one pass."""
    filled = cases.select(F.coalesce("expected_policy", F.lit("allow")).alias("policy"), F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("scenario", F.lit("unknown")).alias("scenario"), F.coalesce("smoke", F.lit(False)).alias("smoke"))
    sets = filled.groupingSets([[F.col("policy")], [F.col("category")], [F.col("scenario")]], F.col("policy"), F.col("category"), F.col("scenario"))
    out = sets.agg(F.count("*").alias("cases"), F.count_if("smoke").alias("smoke"), F.grouping("policy").alias("p"), F.grouping("category").alias("c"))
    return out.select(F.when(F.col("p") == 0, "policy").when(F.col("c") == 0, "category").otherwise("scenario").alias("dimension"), F.coalesce("policy", "category", "scenario").alias("value"), "cases", "smoke")


def gap_flags(cases: DataFrame) -> DataFrame:
    """rule, value, measure of what the cases cover too thinly."""
    counts = coverage_summary(cases)
    thin = counts.filter((F.col("dimension") != "policy") & (F.col("cases") < THIN)).select(F.concat(F.lit("thin_"), "dimension").alias("rule"), "value", F.col("cases").cast("double").alias("measure"))
    unsmoked = counts.filter("dimension = 'scenario' AND smoke = 0").select(F.lit("no_smoke_coverage").alias("rule"), "value", F.lit(0.0).alias("measure"))
    blocked = counts.filter("dimension = 'policy'").agg(F.coalesce(F.sum(F.when(F.col("value") == "block", F.col("cases"))) / F.sum("cases"), F.lit(0.0)).alias("measure"))
    weak = blocked.filter(F.col("measure") < BOUNDARY_SHARE).select(F.lit("weak_boundary_coverage").alias("rule"), F.lit("block").alias("value"), "measure")
    return thin.unionByName(unsmoked).unionByName(weak)


def scenario_rates(results: DataFrame) -> DataFrame:
    """scenario, passed, total, rate; passed: no first-level failure and the judge passed."""
    good = (F.coalesce("l1_failures", F.lit(0)) == 0) & F.coalesce("judge_passed", F.lit(False))
    out = results.groupBy(F.coalesce("scenario", F.lit("unknown")).alias("scenario")).agg(F.count_if(good).alias("passed"), F.count("*").alias("total"))
    return out.withColumn("rate", F.col("passed") / F.col("total"))


def assertion_rates(results: DataFrame, assertions: list[str]) -> DataFrame:
    """assertion, applicable, passed, rate; a null outcome is not applicable."""
    long = results.select(*(F.col(a).cast("boolean") for a in assertions)).unpivot([], assertions, "assertion", "outcome")
    out = long.groupBy("assertion").agg(F.count("outcome").alias("applicable"), F.count_if("outcome").alias("passed"))
    return out.withColumn("rate", F.try_divide("passed", "applicable"))


def section_recall(citations: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, expected, matched, recall, matched_sections, missing_sections: ``expected`` (case_id, pos, act_number, section_number) in its order, each pair once."""
    want = expected.withColumn("p", pair(F.col("act_number"), F.col("section_number"))).filter("p IS NOT NULL").groupBy("case_id", "p").agg(F.min("pos").alias("pos"))
    have = citations.withColumn("p", pair(F.col("act_number"), F.col("section_number"))).filter("p IS NOT NULL").select("case_id", "p").distinct().withColumn("hit", F.lit(True))
    met = want.join(have, ["case_id", "p"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    name = F.concat(F.col("p.act_number"), F.lit("/"), F.col("p.section_number"))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", name.alias("name"))))), lambda x: x["name"])
    out = met.groupBy("case_id").agg(F.count("*").alias("expected"), F.count_if("hit").alias("matched"), listed(F.col("hit")).alias("matched_sections"), listed(~F.col("hit")).alias("missing_sections"))
    return out.withColumn("recall", F.col("matched") / F.col("expected"))


def recall_verdicts(recalls: DataFrame, cases: DataFrame) -> DataFrame:
    met = recalls.join(cases.select("case_id", "min_sections_found"), "case_id")
    return met.select("case_id", "expected", "matched", recall_pass(F.col("matched"), F.col("expected"), F.col("min_sections_found")).alias("passed"))


def eval_summary(results: DataFrame, fail_under: float) -> DataFrame:
    """One row: mean_recall (null without any), judge_rate, existence_rate, released."""
    out = results.agg(F.avg("recall").alias("mean_recall"), F.try_divide(F.count_if("judge_passed"), F.count("judge_passed")).alias("judge_rate"), F.try_divide(F.count_if("citations_exist"), F.count("citations_exist")).alias("existence_rate"))
    return out.withColumn("released", F.coalesce((F.col("existence_rate") == 1) & (F.col("judge_rate") >= fail_under), F.lit(False)))


def present_pairs(chunks: DataFrame) -> DataFrame:
    return chunks.select("act_number", F.upper("section_number").alias("section_number")).distinct()


def totals_by_type(index: DataFrame) -> DataFrame:
    return index.groupBy("act_type").agg(F.count("*").alias("acts"))


def flatten_results(results: DataFrame, most: int = 8) -> DataFrame:
    """The report's row of each nested result: retrieved sections are cut to the first ``most``, failures counted."""
    return results.select("case_id", "category", "scenario", F.col("judge.passed").alias("judge_passed"), F.col("judge.critique").alias("critique"), F.size(F.coalesce("failures", F.array().cast("array<string>"))).alias("l1_failures"), F.transform(F.slice("retrieved", 1, most), lambda r: F.concat(r["act_number"], F.lit("/"), r["section_number"])).alias("retrieved"))


def verdicts(results: DataFrame) -> DataFrame:
    mark = policy.verdict(F.coalesce("l1_failures", F.lit(0)), F.col("judged"), F.col("judge_passed"), F.col("citation_accuracy"), F.col("policy_compliance"))
    return results.withColumn("verdict", mark)


def tool_checks(cases: DataFrame) -> DataFrame:
    """case_id and the outcome of each check of tool_trace: has_tool, in_order, forbidden (those used), capped."""
    capped = F.coalesce(F.forall(F.map_entries("max_calls"), lambda e: policy.call_count(F.col("tool_trace"), e["key"]) <= e["value"]), F.lit(True))
    return cases.select(
        "case_id",
        (F.col("expected_tool").isNull() | F.array_contains("tool_trace", F.col("expected_tool"))).alias("has_tool"),
        policy.is_subsequence(F.col("tool_trace"), F.col("expected_sequence")).alias("in_order"),
        policy.forbidden_used(F.col("tool_trace"), F.coalesce("forbidden_tools", F.array().cast("array<string>"))).alias("forbidden"),
        capped.alias("capped"),
    )


def turn_scores(turns: DataFrame) -> DataFrame:
    """The quality vector of each turn: flags and counters as doubles, query_type as it is."""
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))).cast("double")
    metrics = {"calls": "reference_follow_calls", "skipped": "reference_follow_skipped", "disabled": "reference_follow_disabled", "unavailable": "reference_follow_unavailable", "edges_considered": "reference_edges_considered", "edges_returned": "reference_edges_returned", "targets_looked_up": "reference_targets_looked_up", "targets_resolved": "reference_targets_resolved", "targets_failed": "reference_targets_failed", "boundary_targets": "reference_boundary_targets", "fail_open": "reference_fail_open"}
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return turns.select(
        "turn_id",
        flag(size("violations") == 0).alias("passed"),
        size("violations").alias("num_violations"),
        size("evidence_violations").alias("num_evidence_violations"),
        F.coalesce(F.col("retry_count").cast("double"), F.lit(0.0)).alias("retry_count"),
        size("citations").alias("num_citations"),
        flag(policy.delivered(F.col("violations"), F.col("final"), F.col("draft")) == policy.FALLBACK).alias("fallback_delivered"),
        flag(F.col("query_type") == "escalate").alias("escalated"),
        *(F.coalesce(F.try_element_at("reference_metrics", F.lit(k)).cast("double"), F.lit(0.0)).alias(v) for k, v in metrics.items()),
        F.coalesce("query_type", F.lit("")).alias("query_type"),
    )


def review_sheet(cases: DataFrame, chunks: DataFrame, n: int = 260) -> DataFrame:
    """case_id, sections: for each expected section its text's beginning, or that it is missing, in order."""
    each = case_sections(cases).select("case_id", F.posexplode_outer("sections").alias("pos", "s"))
    text = chunks.groupBy("act_number", F.upper("section_number").alias("section_number")).agg(F.min_by("content", "chunk_ordinal").alias("content"))
    met = each.select("case_id", "pos", "s.act_number", "s.section_number").join(text, ["act_number", "section_number"], "left")
    line = F.concat("act_number", F.lit("/"), "section_number", F.lit(": "), F.when(F.col("content").isNull(), "MISSING SECTION").otherwise(snippet(F.col("content"), n)))
    return met.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", line.alias("line"))))), lambda x: x["line"]).alias("sections"))
