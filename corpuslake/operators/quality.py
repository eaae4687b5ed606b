"""Integrity jobs: a row for each violation, never a partial answer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.keys import content_hash, document_id
from corpuslake.operators.segment import chunk_set_hash


def _rows(df: DataFrame, subject: str | Column, code: str) -> DataFrame:
    return df.select(F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_bundles(chunks: DataFrame, docs: DataFrame, runs: DataFrame) -> DataFrame:
    """code, subject: unknown documents, runs of other documents, chunk counts, chunk and set hashes that don't fit."""
    owned = chunks.filter("extraction_id IS NOT NULL")
    counts = owned.groupBy("extraction_id").agg(F.count("*").alias("stored"))
    sets = chunk_set_hash(owned, "extraction_id").withColumnRenamed("chunk_set_hash", "found_hash")
    known = runs.select("extraction_id", F.col("document_id").alias("run_document"), "chunk_count", F.col("chunk_set_hash").alias("declared_hash"))
    return _union([
        _rows(owned.join(docs.select("document_id"), "document_id", "left_anti").select("document_id").distinct(), "document_id", "document_unknown"),
        _rows(owned.select("extraction_id", "document_id").distinct().join(known, "extraction_id").filter("document_id <> run_document"), "extraction_id", "identity_mismatch"),
        _rows(known.join(counts, "extraction_id", "left").filter("coalesce(stored, 0) <> chunk_count"), "extraction_id", "chunk_count_mismatch"),
        _rows(owned.filter(F.col("content_sha256") != content_hash(F.col("content"))), F.concat_ws("/", "extraction_id", "section_number"), "chunk_hash_mismatch"),
        _rows(known.join(sets, "extraction_id").filter("found_hash <> declared_hash"), "extraction_id", "chunk_set_hash_mismatch"),
    ])


KINDS = ("act", "section", "subsection", "paragraph", "subparagraph", "description", "schedule")
OCCURRENCE = ["source_provision_id", "literal", "start_offset"]


def _broken(df: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """code, subject for each rule that a row breaks, in one pass; a rule that can't be decided isn't broken."""
    each = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items())))
    return df.select(F.explode(each).alias("code"), F.col(subject).cast("string").alias("subject"))


def _repeated(df: DataFrame, own: list[str], key: str, code: str) -> DataFrame:
    twice = df.groupBy(*own, key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return _rows(twice.select(key).union(df.filter(F.col(key).isNull()).select(key)), key, code)


def _version(c: str) -> Column:
    return F.concat(F.col("document_id"), F.lit("/provision:"), F.col(c))


def validate_graph(provisions: DataFrame, edges: DataFrame, unresolved: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """code, subject for every broken rule of a graph: ids, kinds, parents, offsets, version ids, ends of edges, evidence, agreement with the audit.

    Where the tables have a document_id each document is a graph of its own: versions of an act share their ids, and what one lacks another can't lend.
    Columns that a table doesn't have (version ids, evidence, page ranges, candidate ids, notes, targets of an audit) bring no checks. Each table is read once for all
    checks of its rows; repeated ids and partners are found by joins on ids."""
    has = lambda df, *names: set(names) <= set(df.columns)
    own = ["document_id"] if all(has(df, "document_id") for df in (provisions, edges, unresolved)) else []
    known = provisions.select(*own, "provision_id").distinct()

    def flagged(df: DataFrame, of: str, name: str) -> DataFrame:
        """``df`` with ``name``: whether its document has the provision ``of``."""
        return df.join(known.select(*own, F.col("provision_id").alias(of), F.lit(True).alias(name)), [*own, of], "left")

    no = lambda c: F.col(c).isNull()
    unsourced = F.col("evidence").isNull() | (F.coalesce(F.size("evidence.pages"), F.lit(0)) <= 0)

    rules = {
        "provision_kind": no("kind") | ~F.col("kind").isin(*KINDS),
        "provision_offsets": (F.col("start") < 0) | (F.col("end") < F.col("start")),
        "provision_parent": F.col("kind").isin("subsection", "paragraph", "subparagraph") & F.col("parent_id").isNotNull() & no("_parent"),
        "provision_path": ~F.col("provision_id").rlike("^act:[^/]+(/[a-z]+:[^/]+)*$"),
    }
    if has(provisions, "page_start", "page_end"):
        rules["provision_pages"] = (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start"))
    if has(provisions, "version_id", "document_id"):
        rules["provision_version"] = no("version_id") | (F.col("version_id") != _version("provision_id"))
    parts = [_broken(flagged(provisions, "parent_id", "_parent"), "provision_id", rules), _repeated(provisions, own, "provision_id", "provision_duplicate")]

    same_act = F.regexp_extract("target_provision_id", "^(act:[^/]+)", 1) == F.regexp_extract("source_provision_id", "^(act:[^/]+)", 1)
    met = flagged(flagged(edges, "source_provision_id", "_source"), "target_provision_id", "_target")
    rules = {
        "edge_source": no("_source"),
        "edge_target": same_act & F.col("target_provision_id").contains("/") & no("_target"),
        "edge_relationship": F.col("relationship") != "explicit_reference",
        "edge_offsets": (F.col("start_offset") < 0) | (F.col("end_offset") <= F.col("start_offset")),
        "edge_evidence": F.coalesce("literal", F.lit("")) == "",
        "edge_evidence_length": F.length("literal") != F.col("end_offset") - F.col("start_offset"),
    }
    if has(edges, "source_version_id", "target_version_id", "document_id"):
        rules["edge_source_version"] = no("source_version_id") | (F.col("source_version_id") != _version("source_provision_id"))
        rules["edge_target_version"] = ~F.col("target_version_id").eqNullSafe(F.when(F.col("_target"), _version("target_provision_id")))
        rules["edge_cross_act_version"] = ~same_act & F.col("target_version_id").isNotNull()
    if has(edges, "evidence"):
        rules["edge_provenance"] = unsourced
    if audit is not None:
        at = [*(["document_id"] if has(edges, "document_id") and has(audit, "document_id") else []), *OCCURRENCE]
        seen = audit.groupBy(*at).agg(F.bool_or(F.col("decision") == "approved").alias("_approved"), F.bool_or(F.col("decision") == "rejected").alias("_rejected"), *([F.flatten(F.collect_set("target_provision_ids")).alias("_aims")] if has(audit, "target_provision_ids") else []))
        met = met.join(seen, at, "left")
        aimed = F.array_contains("_aims", F.col("target_provision_id")) if has(audit, "target_provision_ids") else F.lit(True)
        rules["audit_rejected_edge"] = F.col("_rejected")
        rules["edge_not_approved"] = ~F.coalesce(F.col("_approved") & aimed, F.lit(False))
    parts += [_broken(met, "edge_id", rules), _repeated(edges, own, "edge_id", "edge_duplicate")]

    def of_candidates(df: DataFrame) -> dict[str, Column]:
        found = {"candidate_provenance": unsourced} if has(df, "evidence") else {}
        return found | ({"candidate_source_version": no("source_version_id") | (F.col("source_version_id") != _version("source_provision_id"))} if has(df, "source_version_id", "document_id") else {})

    loose = flagged(unresolved, "source_provision_id", "_source")
    parts.append(_broken(loose, "source_provision_id", {"unresolved_reason": F.coalesce("reason", F.lit("")) == "", "unresolved_source": no("_source")} | of_candidates(unresolved)))
    if audit is None:
        return _union(parts)

    name = "candidate_id" if has(audit, "candidate_id") else "source_provision_id"
    linked = audit.join(edges.select(*at).distinct().withColumn("_edge", F.lit(True)), at, "left")
    rules = {
        "audit_undecided": no("decision") | ~F.col("decision").isin("approved", "rejected"),
        "audit_approved_missing": (F.col("decision") == "approved") & no("_edge") & (F.col("resolution") == "resolved" if has(audit, "resolution") else F.lit(True)),
        "rejected_edge_present": (F.coalesce("decision", F.lit("")) != "approved") & F.col("_edge"),
    } | of_candidates(audit)
    if has(audit, "audit_note"):
        rules["audit_note_missing"] = F.trim(F.coalesce("audit_note", F.lit(""))) == ""
    if has(audit, "candidate_id") and has(unresolved, "candidate_id"):
        by = ["document_id", "candidate_id"] if has(audit, "document_id") and has(unresolved, "document_id") else ["candidate_id"]
        given_up = unresolved.filter("reason = 'audit_rejected'").select(*by).distinct().withColumn("_given_up", F.lit(True))
        linked = linked.join(given_up, by, "left")
        rules["rejected_unresolved_missing"] = (F.coalesce("decision", F.lit("")) != "approved") & no("_given_up")
        twice = audit.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1 OR candidate_id IS NULL")
        parts.append(_rows(twice, "candidate_id", "audit_duplicate"))
    parts.append(_broken(linked, name, rules))
    parts.append(_rows(audit.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1"), "source_provision_id", "audit_occurrence_ambiguous"))
    if has(audit, "target_provision_ids"):
        by = ["document_id"] if "document_id" in at else []
        wanted = audit.filter("decision = 'approved'").select(*at, name, F.explode("target_provision_ids").alias("target_provision_id"))
        parts.append(_rows(wanted.join(edges.select(*at, "target_provision_id").distinct(), [*at, "target_provision_id"], "left_anti").select(*by, name).distinct(), name, "approved_edge_missing"))
    return _union(parts)


def validate_registry(docs: DataFrame, runs: DataFrame, active: DataFrame, aliases: DataFrame) -> DataFrame:
    """code, subject: ids that aren't made from their fields, repeated ids, runs, mappings and aliases that point nowhere."""
    known = docs.select("document_id").distinct()
    ready = runs.filter("status = 'ready'").select("document_id", "extraction_id")
    return _union([
        _rows(docs.filter(~F.coalesce(F.col("document_id") == document_id(F.col("act_number"), F.col("language"), F.col("sha256")), F.lit(False))), "document_id", "document_id_mismatch"),
        _rows(docs.groupBy("document_id").agg(F.count("*").alias("n")).filter("n > 1"), "document_id", "document_duplicate"),
        _rows(docs.filter("byte_size <= 0 OR page_count <= 0"), "document_id", "document_size"),
        _rows(runs.join(known, "document_id", "left_anti"), "extraction_id", "extraction_orphan"),
        _rows(active.join(ready, ["document_id", "extraction_id"], "left_anti"), "extraction_id", "active_not_ready"),
        _rows(active.groupBy("act_number", "language").agg(F.count("*").alias("n")).filter("n > 1"), F.concat_ws("/", "act_number", "language"), "active_duplicate"),
        _rows(aliases.join(known, F.col("target") == F.col("document_id"), "left_anti"), "alias", "alias_target"),
    ])


def validate_contract(df: DataFrame, key: str, required: tuple[str, ...] = (), const: Mapping[str, object] | None = None, enum: Mapping[str, tuple] | None = None) -> DataFrame:
    """code, subject for missing fields, wrong constants and unknown values; one pass over the table."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"required:{c}")) for c in required]
    checks += [F.when(F.col(c).isNotNull() & (F.col(c) != v), F.lit(f"const:{c}")) for c, v in (const or {}).items()]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(f"enum:{c}")) for c, v in (enum or {}).items()]
    return df.select(F.explode(F.array_compact(F.array(*checks))).alias("code"), F.col(key).cast("string").alias("subject"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row, equal: both tables have the same ids, repeats counted."""
    left, right = a.select(key), b.select(key)
    return left.exceptAll(right).unionAll(right.exceptAll(left)).agg((F.count("*") == 0).alias("equal"))


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, mark: a sum of row hashes that doesn't depend on their order."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("mark"))


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows, equal: whether two tables of the same columns have the same rows, whatever their order; by number and summed hashes."""
    one, two = fingerprint(a), fingerprint(b.select(*a.columns))
    return one.select("rows", "mark", F.lit(1).alias("k")).join(two.select(F.col("mark").alias("_mark"), F.col("rows").alias("_rows"), F.lit(1).alias("k")), "k").select("rows", ((F.col("mark") == F.col("_mark")) & (F.col("rows") == F.col("_rows"))).alias("equal"))
