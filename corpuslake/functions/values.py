"""Text, number and vector helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.keys import text_of, trimmed

DASHES, APOSTROPHES = "‐‑‒–—―−", "‘’‛′＇"
TOKEN = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"


def normalize_text(c: Column) -> Column:
    """Soft hyphens out, dashes and apostrophes folded, lower case; NFKC and case folding are ``functions.udfs.nfkc_casefold``."""
    folded = F.translate(text_of(c), DASHES + APOSTROPHES, "-" * len(DASHES) + "'" * len(APOSTROPHES))
    return F.lower(F.replace(folded, F.lit("­"), F.lit("")))


def normalize_wording(c: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(text_of(c), r"\s+", " ")))


def tokens(c: Column) -> Column:
    """Letters and digits, with hyphens and apostrophes inside."""
    return F.regexp_extract_all(normalize_text(c), F.lit(f"({TOKEN})"), F.lit(1))


def snippet(c: Column, n: int = 260) -> Column:
    flat = trimmed(F.regexp_replace(text_of(c), r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(n - 1)), r"\s+$", ""), F.lit("…")))


def render_fields(**fields: Column) -> Column:
    """``name: value; ...`` of those that have a value."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in fields.items()))), "; ")


def recency(updated_at: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """Halves with each half-life; 0 without a date, 1 for dates to come."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(updated_at)) / 86_400e6)
    return F.coalesce(F.pow(F.lit(0.5), days / half_life_days), F.lit(0.0))


def memory_score(updated_at: Column, recall_count: Column, now: Column, w_recency: float = 1.0, w_recall: float = 2.0) -> Column:
    return w_recency * recency(updated_at, now) + w_recall * F.coalesce(recall_count, F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def evidence_pages(pages: Column) -> Column:
    """Sorted page numbers of an array of structs, each once."""
    return F.array_sort(F.array_distinct(F.transform(pages, lambda p: p["page_number"])))


def recall_pass(matched: Column, expected: Column, min_found: Column) -> Column:
    """Null where nothing is expected; ``min_found`` defaults to all and is clamped to what there is."""
    need = F.greatest(F.lit(0), F.least(F.coalesce(min_found, expected), expected))
    return F.when(expected > 0, matched >= need)
