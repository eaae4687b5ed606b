"""Identifiers, references, dates and addresses as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of identifiers in legal texts (English and Malay labels).
ACT_PREFIX = r"(?i)^(?:ACT|AKTA)(?:\s+NO\.?)?\s+"
SECTION_LABEL = r"(?i)^\s*(?:(?:SECTION|SEKSYEN|ARTICLE|PERKARA|SEC|S)\.?\s*)?([0-9]+[A-Z]{0,2})\b"
SECTION_IN_TEXT = r"(?i)\b(?:seksyen|sek\.?|section|sec\.?|s\.?)\s*([0-9]+[A-Z]{0,2})\b"
ACT_IN_TEXT = r"(?i)\bact\s+([0-9]+[A-Z]?)\b"
#: Names that stand for an act number.
ACT_NAMES = {
    "evidence act": "56",
    "akta keterangan": "56",
    "penal code": "574",
    "kanun keseksaan": "574",
    "criminal procedure code": "593",
    "cpc": "593",
    "employment act": "265",
    "akta pekerjaan": "265",
    "companies act": "777",
    "akta syarikat": "777",
    "pdpa": "709",
    "akta pdpa": "709",
    "personal data protection act": "709",
    "akta perlindungan data peribadi": "709",
}


def trimmed(c: Column) -> Column:
    """Without white space at both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def canonical_act(c: Column) -> Column:
    return F.upper(trimmed(F.regexp_replace(trimmed(text_of(c)), ACT_PREFIX, "")))


def canonical_section(c: Column) -> Column:
    return F.upper(F.regexp_extract(text_of(c), SECTION_LABEL, 1))


def extract_section(c: Column) -> Column:
    """Section number in free text, or null."""
    return F.upper(F.nullif(F.regexp_extract(text_of(c), SECTION_IN_TEXT, 1), F.lit("")))


def act_hint(c: Column, names: Mapping[str, str] = ACT_NAMES) -> Column:
    """Act number that a text names: the first known name in the table's order, then ``act <number>``, else null.

    The table is a small parameter and travels in the plan."""
    low = F.lower(text_of(c))
    named = [F.when(low.rlike(rf"\b{name}\b"), F.lit(act)) for name, act in names.items()]
    return F.coalesce(*named, F.upper(F.nullif(F.regexp_extract(text_of(c), ACT_IN_TEXT, 1), F.lit(""))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(text_of(c))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def document_id(act: Column, language: Column, sha: Column) -> Column:
    """``act-<slug>-<language>-sha256-<hex>``; null where a part is unusable."""
    language, sha = F.lower(language), F.lower(sha)
    fine = (slug(act) != "") & language.rlike(r"^[a-z][a-z0-9-]{1,15}$") & sha.rlike(r"^[0-9a-f]{64}$")
    return F.when(fine, F.concat(F.lit("act-"), slug(act), F.lit("-"), language, F.lit("-sha256-"), sha))


def asset_key(sha: Column, suffix: str = ".pdf") -> Column:
    if suffix not in (".pdf", ".words.json.gz", ".chunks.json"):
        raise ValueError(f"unknown kind of file: {suffix}")
    return F.concat(F.lit("statutes/sha256/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha, F.lit(suffix))


def content_hash(c: Column) -> Column:
    return F.sha2(text_of(c), 256)


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys and nulls kept."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def extraction_id(document: Column, extractor: Column, version: Column, configuration: Column) -> Column:
    return F.concat(F.lit("extraction-sha256-"), canonical_hash(document_id=document, extractor=extractor, extractor_version=version, configuration_hash=configuration))


def _short_id(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), F.lit(16))


def candidate_id(source: Column, start: Column, literal: Column) -> Column:
    return F.concat(F.lit("candidate:"), _short_id(source, start, literal))


def edge_id(source: Column, target: Column, start: Column, literal: Column) -> Column:
    return F.concat(F.lit("edge:"), _short_id(source, target, start, literal))


def strict_date(c: Column) -> Column:
    """``dd/MM/yyyy`` with both zeros, or null."""
    return F.when(c.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.to_date(F.try_to_timestamp(c, F.lit("dd/MM/yyyy"))))


def lenient_date(c: Column) -> Column:
    """Days and months may lack their zero."""
    return F.when(c.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.to_date(F.try_to_timestamp(c, F.lit("d/M/yyyy"))))


def pdf_url(c: Column, base: str = "https://lom.agc.gov.my") -> Column:
    """Address of the file that a viewer address shows; direct addresses stay, relative ones get the base."""
    raw = text_of(c)
    shown = F.try_url_decode(F.regexp_extract(raw, r"[?&]file=([^&#]*)", 1))
    from_root = F.regexp_extract(shown, r"(ilims/.*)$", 1)
    viewed = F.when(shown == "", "").when(from_root != "", F.concat(F.lit(base + "/"), from_root)).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(shown, r"^[./]+", "")))
    direct = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(raw, "^/+", "")))
    return F.when(raw == "", "").when(raw.contains("viewer.html"), viewed).otherwise(direct)


def encode_url(c: Column) -> Column:
    """Percent-encoding of everything but letters, digits, ``_.-~`` and ``:/?=&#@%+``."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for plain in "%:/?=&#@+~":
        out = F.replace(out, F.lit(f"%{ord(plain):02X}"), F.lit(plain)) if plain != "%" else out
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%25"), F.lit("%"))


def split_title(c: Column) -> Column:
    """Struct (bm, en) of a title cell with one link a language; plain text counts as English."""
    plain = lambda x: trimmed(F.regexp_replace(x, "<[^>]+>", ""))
    link = lambda code: plain(F.regexp_extract(text_of(c), rf'(?is)<a\b[^>]*lang={code}[^>]*>(.*?)</a>', 1))
    whole = trimmed(F.regexp_replace(F.regexp_replace(text_of(c), "<[^>]+>", " "), r"\s+", " "))
    none = (link("BM") == "") & (link("BI") == "")
    return F.struct(link("BM").alias("bm"), F.when(none, whole).otherwise(link("BI")).alias("en"))


def source_language(detail_url: Column, source_url: Column) -> Column:
    marker = F.lower(F.concat(text_of(detail_url), F.lit(" "), text_of(source_url)))
    return F.when(marker.contains("lang=bm") | marker.contains("/my/") | marker.contains("_bm/"), "bm").otherwise("en")


def path_depth(c: Column) -> Column:
    return F.size(F.split(c, "/")) - 1


def path_act(c: Column) -> Column:
    return F.regexp_extract(c, r"^act:([^/]+)", 1)


def path_section(c: Column) -> Column:
    return F.regexp_extract(c, r"/section:([^/]+)", 1)


def in_scope(c: Column, root: Column) -> Column:
    """The node itself or one below it."""
    return (c == root) | c.startswith(F.concat(root, F.lit("/")))


def expand_range(c: Column, widest: int = 200) -> Column:
    """Numbers of ``a to b``, both included; null unless it is a rising range of at most ``widest``."""
    low, high = (F.regexp_extract(c, r"^\s*([0-9]+)\s*(?:to|–|-)\s*([0-9]+)\s*$", i).try_cast("int") for i in (1, 2))
    return F.when(low.isNotNull() & high.isNotNull() & (high >= low) & (high - low <= widest), F.sequence(low, high))


def deep_link(source_url: Column, reprint_url: Column, page: Column) -> Column:
    base = F.coalesce(F.nullif(source_url, F.lit("")), F.nullif(reprint_url, F.lit("")), F.lit(""))
    return F.when((base != "") & (page > 0), F.concat(base, F.lit("#page="), page.cast("string"))).otherwise(base)
