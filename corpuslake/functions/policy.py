"""Checks of questions and answers as Column predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.keys import text_of

#: Phrases that rules look for.
ESCALATION = ("my client", "am i liable", "i have been charged", "i was charged", "my case", "represent me", "legal advice")
ESCALATION_IN_DRAFT = ("my client", "am i liable", "i have been charged")
ADVICE = ("you should", "you must", "in your case", "i recommend", "you need to", "you are advised")
DISCLAIMERS = ("does not constitute legal advice",)
REFERENCE_INTENT = (
    r"\brefer(?:s|red|enced|ring)?\s+(?:to|by)\b",
    r"\bprovisions?\s+(?:referenced|cited|mentioned)\b",
    r"\bsubject\s+to\b",
    r"\bnotwithstanding\b",
    r"\bdefin(?:ition|ed)\b.{0,80}\b(?:under|in|by)\s+(?:another\s+)?(?:provision|section)\b",
    r"\bmerujuk\s+(?:kepada|oleh)\b",
    r"\btertakluk\s+kepada\b",
    r"\bwalau\s+apa\s+pun\b",
)
REFERENCE_FEEDBACK = r"\b(?:missing|missed|unsupported)\b.{0,100}\b(?:directly\s+)?refer(?:red|enced|ence)\b"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
REFUSAL = r"(?i)i(?:'m| am) (?:an? )?(?:ai|language model|llm|chatbot)|as an ai|i cannot (?:provide|give|offer) (?:legal )?advice|i(?:'m| am) not able to|i cannot assist with"
MALAY_WORDS = (
    "apakah", "bagaimana", "bolehkah", "adakah", "apabila", "kepada", "oleh", "dalam", "adalah", "dengan", "untuk", "dan", "atau", "tidak", "jika", "sekiranya",
    "mahkamah", "akta", "seksyen", "undang-undang", "peguam", "pendakwa", "tertuduh", "plaintif", "defendan", "hakim", "rayuan", "majikan", "pekerja", "gaji", "syarikat", "fitnah",
)
NO_ADVICE = "The draft tells the reader what to do."
NO_DISCLAIMER = "The draft does not say that it is no legal advice."
ESCALATED = "The draft touches a matter for a person to answer."
FALLBACK = "No properly cited answer could be put together."


def any_phrase(phrases: Sequence[str]) -> str:
    return "(?i)" + "|".join(rf"\b{p}\b" for p in phrases)


def is_escalation(query: Column) -> Column:
    return text_of(query).rlike(any_phrase(ESCALATION))


def policy_violations(draft: Column, disclaimers: Sequence[str] = DISCLAIMERS) -> Column:
    """Array of violations; an escalation trigger in the draft replaces all others."""
    draft = text_of(draft)
    stated = F.lower(draft).rlike("|".join(disclaimers))
    found = F.array_compact(F.array(F.when(draft.rlike(any_phrase(ADVICE)), F.lit(NO_ADVICE)), F.when(~stated, F.lit(NO_DISCLAIMER))))
    return F.when(draft.rlike(any_phrase(ESCALATION_IN_DRAFT)), F.array(F.lit(ESCALATED))).otherwise(found)


def uuid_leak(response: Column) -> Column:
    return text_of(response).rlike(UUID)


def ai_refusal(response: Column, policy: Column) -> Column:
    return (F.coalesce(policy, F.lit("")) == "allow") & text_of(response).rlike(REFUSAL)


def has_word(text: Column, words: Sequence[str] = MALAY_WORDS) -> Column:
    """Words count inside longer words too."""
    return F.lower(text_of(text)).rlike("|".join(words))


def register_mismatch(query: Column, response: Column, words: Sequence[str] = MALAY_WORDS) -> Column:
    return has_word(query, words) & ~has_word(response, words)


def reference_intent(query: Column, feedback: Column) -> Column:
    return text_of(query).rlike("(?i)" + "|".join(REFERENCE_INTENT)) | text_of(feedback).rlike("(?i)" + REFERENCE_FEEDBACK)


def delivered(violations: Column, final: Column, draft: Column, fallback: str = FALLBACK) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.when(F.size(F.coalesce(violations, F.array())) > 0, fallback).otherwise(F.coalesce(filled(final), filled(draft), F.lit("")))


def strip_suffix(c: Column, suffixes: Sequence[str]) -> Column:
    """Without the first of the exact endings that it has."""
    cut = [F.when(c.endswith(s), F.left(c, F.length(c) - len(s))) for s in suffixes]
    return F.coalesce(*cut, c)


def is_subsequence(trace: Column, wanted: Column) -> Column:
    """All of ``wanted`` occurs in ``trace`` in this order, other entries between."""
    trace, wanted = F.coalesce(trace, F.array().cast("array<string>")), F.coalesce(wanted, F.array().cast("array<string>"))
    met = F.aggregate(trace, F.lit(0), lambda i, t: F.when((i < F.size(wanted)) & (t == F.get(wanted, i)), i + 1).otherwise(i))
    return met == F.size(wanted)


def call_count(trace: Column, tool: Column | str) -> Column:
    return F.size(F.filter(F.coalesce(trace, F.array().cast("array<string>")), lambda t: t == tool))


def forbidden_used(trace: Column, forbidden: Column) -> Column:
    return F.array_sort(F.array_intersect(trace, forbidden))


def verdict(failures: Column, judged: Column, passed: Column, accuracy: Column, compliance: Column) -> Column:
    """L1_FAIL, SKIP, PASS or FAIL; records without ``passed`` fall back to two older flags, true if missing."""
    old = F.coalesce(accuracy, F.lit(True)) & F.coalesce(compliance, F.lit(True))
    return F.when(failures > 0, "L1_FAIL").when(~judged, "SKIP").when(F.coalesce(passed, old), "PASS").otherwise("FAIL")
