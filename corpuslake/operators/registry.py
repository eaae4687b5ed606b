"""Documents, versions, activation and rollout planning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.keys import document_id, lenient_date, strict_date
from corpuslake.sources.scratch import checkpointed

REPRINTS = ("REPRINT ONLINE", "REPRINT")


def latest_reprint(timeline: DataFrame) -> DataFrame:
    """act_number, reprint_url: the newest dated reprint that has a file; of equal dates the first."""
    dated = timeline.filter(F.col("log_type").isin(*REPRINTS) & (F.coalesce("pdf_url", F.lit("")) != "")).withColumn("_date", lenient_date(F.col("date"))).filter("_date IS NOT NULL")
    newest = F.row_number().over(Window.partitionBy("act_number").orderBy(F.desc("_date"), "pos"))
    return dated.withColumn("_n", newest).filter("_n = 1").select("act_number", F.col("pdf_url").alias("reprint_url"))


def latest_amendment(timeline: DataFrame) -> DataFrame:
    listed = timeline.filter("log_type = 'AMENDMENTS' AND coalesce(pdf_url, '') <> ''")
    return listed.groupBy("act_number").agg(F.max_by("pdf_url", "pos").alias("amendment_url"))


def classify_coverage(files: DataFrame) -> DataFrame:
    """``files`` with reason, status, requires_redownload, requires_reextraction. Columns read: has_metadata, source_url, readable,
    act_title, scanned, is_active, ready_runs, legacy_chunks (null: no chunk file). The first reason that holds counts."""
    f = F.col
    reason = (
        F.when(~f("has_metadata"), "metadata_missing")
        .when(F.coalesce(f("source_url"), F.lit("")) == "", "amendment_only")
        .when(~f("readable"), "corrupt_pdf")
        .when(F.coalesce(f("act_title"), F.lit("")) == "", "title_missing")
        .when(f("scanned"), "scanned_image_only")
        .when(f("is_active") & (f("ready_runs") > 0), "verified_active_extraction")
        .when(f("ready_runs") > 0, "verified_shadow_extraction")
        .when(f("legacy_chunks").isNull(), "not_extracted")
        .when(f("legacy_chunks") == 0, "no_chunks")
        .otherwise("legacy_chunks_without_provenance")
    )
    out = files.withColumn("reason", reason)
    status = F.when(f("reason") == "verified_active_extraction", "enabled").when(f("reason") == "verified_shadow_extraction", "ready").otherwise("blocked")
    return out.withColumns({"status": status, "requires_redownload": f("reason").isin("metadata_missing", "amendment_only", "corrupt_pdf"), "requires_reextraction": ~f("reason").isin("metadata_missing", "title_missing", "verified_active_extraction", "verified_shadow_extraction")})


def coverage_counts(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("status", "reason").agg(F.count("*").alias("files"), F.count_if("requires_redownload").alias("to_download"), F.count_if("requires_reextraction").alias("to_extract"))


def eligible(documents: DataFrame) -> DataFrame:
    return documents.filter("document_kind = 'reprint' AND coalesce(act_title, '') <> '' AND lifecycle_status IN ('registered', 'extracted')")


def snapshot_catalog(timeline: DataFrame, docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Consolidated timeline rows with their registered document, if any, and its smallest alias."""
    preferred = aliases.groupBy(F.col("target").alias("document_id")).agg(F.min("alias").alias("alias"))
    rows = timeline.filter(F.col("log_type").isin(*REPRINTS)).select("act_number", "date", F.col("pdf_url").alias("source_url"))
    met = rows.join(docs.select("act_number", "source_url", "document_id"), ["act_number", "source_url"], "left").join(preferred, "document_id", "left")
    return met.select("act_number", "date", "source_url", "document_id", F.coalesce("alias", "document_id").alias("snapshot_id"))


def snapshot_readiness(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """``catalog`` with readiness and why: registered snapshots are ready; others by ``facts`` (source_url, readable, scanned)."""
    met = catalog.join(facts.select("source_url", "readable", "scanned"), "source_url", "left")
    state = F.when(F.col("document_id").isNotNull(), "ready").when(~F.coalesce("readable", F.lit(False)), "blocked").when(F.col("scanned"), "scanned_unparseable").otherwise("ready")
    why = F.when(F.col("document_id").isNotNull(), "already_registered").when(F.col("readable").isNull(), "not_fetched").when(~F.col("readable"), "corrupt_pdf").when(F.col("scanned"), "scanned_image_only").otherwise("text_layer")
    return met.select(*catalog.columns, state.alias("readiness"), why.alias("why"))


def order_snapshots(df: DataFrame) -> DataFrame:
    """By strict date, malformed dates last, then id."""
    return df.withColumn("parsed_date", strict_date(F.col("date"))).orderBy(F.col("parsed_date").asc_nulls_last(), "snapshot_id")


def versions_for_act(documents: DataFrame, act: str, language: str | None = None) -> DataFrame:
    out = documents.filter(F.col("act_number") == act)
    return (out.filter(F.col("language") == language) if language else out).orderBy("language", "document_id")


def preferred_mapping(active: DataFrame) -> DataFrame:
    """One mapping an act: English, or else the first other language."""
    order = F.row_number().over(Window.partitionBy("act_number").orderBy(F.col("language") != "en", "language"))
    return active.withColumn("_n", order).filter("_n = 1").drop("_n")


def ready_extractions(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ready runs whose stored chunks are as many as declared."""
    stored = chunks.filter("extraction_id IS NOT NULL").groupBy("extraction_id").agg(F.count("*").alias("stored"))
    return runs.filter("status = 'ready'").join(stored, "extraction_id").filter("stored = chunk_count")


def rollout_plan(docs: DataFrame, runs: DataFrame, chunks: DataFrame, active: DataFrame) -> DataFrame:
    """document_id, step, failure: what each document still needs, and why it can't be taken on as it is (null where it can).

    Of the ready runs of an act and language the one that the active mapping names is meant, whatever others there are: documents without it are
    ``superseded``. Where nothing is active several ready runs are ``ambiguous``. Null languages are a language of their own."""
    ready = runs.filter("status = 'ready'").select("document_id", "extraction_id").distinct()
    whole = ready_extractions(runs, chunks).select("extraction_id").distinct().withColumn("whole", F.lit(True))
    of = docs.select("document_id", F.coalesce("act_number", F.lit("")).alias("_act"), F.coalesce("language", F.lit("")).alias("_language"))
    several = of.join(ready, "document_id").groupBy("_act", "_language").agg(F.count("*").alias("several"))
    named = active.select(F.coalesce("act_number", F.lit("")).alias("_act"), F.coalesce("language", F.lit("")).alias("_language"), F.col("extraction_id").alias("named")).distinct()
    met = of.join(ready, "document_id", "left").join(several, ["_act", "_language"], "left").join(named, ["_act", "_language"], "left").join(whole, "extraction_id", "left")
    chosen = F.when(F.col("named").isNotNull(), F.col("extraction_id") == F.col("named")).otherwise(F.col("several") == 1)
    step = F.when(F.col("extraction_id").isNull(), 5).when(~chosen, F.when(F.col("named").isNull(), 4).otherwise(3)).when(F.col("whole").isNull(), 2).when(F.col("named").isNull(), 1).otherwise(0)
    # A document counts by its run that is furthest on.
    names = F.array(*(F.lit(n) for n in ("done", "activate", "ingest", "superseded", "ambiguous", "prepare")))
    plan = met.groupBy("document_id").agg(F.element_at(names, F.min(step) + 1).alias("step"))
    failure = F.when(F.col("step") == "ambiguous", "several ready versions and no active mapping").when(F.col("step") == "prepare", "no ready extraction")
    return plan.withColumn("failure", failure)


def rollout_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("candidates"), *(F.count_if(F.col("step") == s).alias(s) for s in ("ambiguous", "superseded", "prepare", "ingest", "activate", "done")))


def carry_superseded(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``current``, and earlier documents that were not found again, as superseded."""
    gone = previous.join(current.select("document_id"), "document_id", "left_anti").withColumn("lifecycle_status", F.lit("superseded"))
    return current.unionByName(gone)


def upsert_immutable(current: DataFrame, incoming: DataFrame, key: str, immutable: Sequence[str], mutable: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(table, conflicts): an id that comes again with other immutable fields is a conflict and changes nothing."""
    a, b = current.alias("a"), incoming.alias("b")
    met = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = F.lit(True)
    for c in immutable:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    clash = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull() & ~same
    fresh = F.col(f"b.{key}").isNotNull() & ~clash
    pick = lambda c, new: F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    table = met.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(pick(c, F.col(f"a.{key}").isNull()) for c in immutable), *(pick(c, fresh) for c in mutable))
    return table, met.filter(clash).select(F.col(f"b.{key}").alias(key), *(F.col(f"b.{c}").alias(c) for c in immutable))


def with_previous(log: DataFrame) -> DataFrame:
    """Activations with the extraction that was active before, by act and language."""
    return log.withColumn("previous_id", F.lag("extraction_id").over(Window.partitionBy("act_number", "language").orderBy("seq")))


def activation_state(log: DataFrame) -> DataFrame:
    """act_number, language, seq, action, extraction_id, previous_id after each entry of a log of ``activate`` and ``rollback``
    entries. A rollback swaps the active and the previous extraction of the newest history entry that has a previous one; without
    one it changes nothing. State runs along a key's log, so the fold sees one key's entries at a time."""

    def fold(_, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            now = before = None
            rows = []
            for r in g.sort_values("seq").itertuples():
                if r.action == "activate":
                    before, now = (now if now is not None else before), r.extraction_id
                    rows.append((r.act_number, r.language, r.seq, r.action, now, before))
                elif before is not None:
                    before, now = now, before
                    rows.append((r.act_number, r.language, r.seq, r.action, now, before))
            yield pd.DataFrame(rows, columns=["act_number", "language", "seq", "action", "extraction_id", "previous_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(fold(None, iter([pdf])))

    return log.groupBy("act_number", "language").applyInPandas(run, "act_number string, language string, seq long, action string, extraction_id string, previous_id string")


def embedding_cost(chunks: DataFrame, price_per_million: Decimal, cap: Decimal | None = None) -> DataFrame:
    """tokens, cost_usd, token_limit, affordable of a chunk table with ``tokens``."""
    price = F.lit(price_per_million).cast("decimal(12,6)")
    limit = F.lit(int(cap * 1_000_000 / price_per_million) if cap is not None else None).cast("long")
    total = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.select("tokens", (F.col("tokens").cast("decimal(18,0)") * price / 1_000_000).cast("decimal(18,6)").alias("cost_usd"), limit.alias("token_limit"), (F.col("tokens") <= F.coalesce(limit, F.col("tokens"))).alias("affordable"))


def admit_within_budget(docs: DataFrame, cost: str, cap: int, key: str = "doc_id") -> DataFrame:
    """The documents before the first one, by ``key``, with which the summed cost goes over ``cap``. Documents without a key come first.

    Spark deals the documents out in ranges of the key; costs are summed per range, these few sums are prefix-summed, and documents only
    within their range, so no task sorts all of them."""
    dealt = checkpointed(docs.repartitionByRange(key).withColumn("_b", F.spark_partition_id()))
    totals = dealt.groupBy("_b").agg(F.sum(cost).alias("_t"))
    # As many rows as there are ranges.
    ahead = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    upto = F.sum(cost).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("_upto", upto).join(F.broadcast(ahead), "_b").withColumn("running", F.col("_ahead") + F.col("_upto"))
    # Costs aren't negative: what fits is what stands before the first overflow.
    return summed.filter(F.col("running") <= cap).drop("_b", "_upto", "_ahead")


def split_long(df: DataFrame, max_tokens: int, words: str = "tokens") -> DataFrame:
    """``df`` with its token array cut into segments: segment (from 0), part, weight (its tokens)."""
    at = F.sequence(F.lit(0), F.ceil(F.size(words) / max_tokens).cast("int") - 1)
    rows = df.filter(F.size(words) > 0).select("*", F.explode(at).alias("segment"))
    return rows.withColumn("part", F.slice(words, F.col("segment") * max_tokens + 1, max_tokens)).withColumn("weight", F.size("part"))


def migrate_manifest(v1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, aliases) of rows of the older schema: ids are made anew, the old ones stay as aliases."""
    new = document_id(F.col("act_number"), F.coalesce("language", F.lit("en")), F.col("sha256"))
    rows = v1.withColumn("new_id", new).filter("new_id IS NOT NULL")
    documents = rows.drop("document_id").withColumnRenamed("new_id", "document_id").dropDuplicates(["document_id"])
    return documents, rows.filter("document_id IS NOT NULL AND document_id <> new_id").select(F.col("document_id").alias("alias"), F.col("new_id").alias("target")).distinct()
