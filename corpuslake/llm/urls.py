"""URL filters: fixed rules first, then empirical-Bayes host reputation, in DataFrame functions only.

Labelled pages (1 bad, 0 good) are counted per host; counts add up to registered domains and suffixes. Each
level's outcomes are shrunk towards the level above by a beta prior whose mean is the parent's rate and whose
strength is fitted to the spread of the level's own rates (method of moments, over all of them): suffixes
towards the whole, domains towards their suffix, hosts towards their domain. A host is blocked where the
lower bound of its posterior is above the threshold, so a few bad pages don't block a host.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, and is judged by the
whole's rate; a host without labelled pages is judged by its domain, suffix or the whole; null or
unknown labels don't count; repeated rows are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import ascii_lower, checkpointed

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules travel in the query plan; a longer list is refused.
MOST_RULES = 1000
#: A suffix has two labels where a country's is divided by kind, as co.uk and com.au are; any other is the last label.
WIDE_SUFFIX = "^(ac|co|com|edu|gen|go|gob|gov|gouv|ltd|mil|ne|net|nom|or|org|plc|sch)[.][a-z][a-z]$"
#: A name that more than one row in so many has is looked up in a broadcast table, which has no more rows than this.
HOT_NAMES = 1000
#: Bounds of the fitted prior strengths, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_of(host: Column) -> Column:
    last = F.substring_index(host, ".", -2)
    return F.when(last.rlike(WIDE_SUFFIX), last).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).rlike(WIDE_SUFFIX), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(level: DataFrame) -> float:
    """The prior strength at which beta-binomial counts spread as these do about their parents' rates.

    With n pages and bad share r, E[(r - mean)^2] = mean (1 - mean) (1/n + (1 - 1/n) / (m + 1)); sums over the level
    are solved for m. Units with one page say nothing about it."""
    mean = F.col("parent")
    var = mean * (1 - mean)
    over, room = F.sum(F.pow(F.col("bad") / F.col("n") - mean, 2) - var / F.col("n")), F.sum(var * (1 - 1 / F.col("n")))
    rho = F.coalesce(F.try_divide(over, room), F.lit(1 / (MOST_STRENGTH + 1)))
    bounded = F.greatest(F.lit(1 / (MOST_STRENGTH + 1)), F.least(F.lit(1 / (LEAST_STRENGTH + 1)), rho))
    return level.filter("n > 1").agg((1 / bounded - 1).alias("m")).first().m


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key`` (a row for each name there): names with a large share of all rows without a shuffle of these, others by one."""
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") * HOT_NAMES > total).select(key, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(F.broadcast(hot).join(table, key, "left")), key, "left")
    rest = marked.filter("_hot IS NULL").select(*rows.columns).join(table, key, "left")
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def reputation(labelled: DataFrame, z: float = 1.645) -> DataFrame:
    """level (host, domain, suffix, all), name, n, bad, rate, lower, from host and bad (0 or 1) of labelled pages.

    Sums run over pre-aggregated hosts, and each level is kept before the next one is shrunk towards it; rates are rounded to 9 places so that
    they don't hang on the order of sums."""
    counts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = checkpointed(counts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"))
    domains = checkpointed(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = checkpointed(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    bound = F.round(F.greatest(F.lit(0.0), F.col("rate") - z * F.sqrt("var")), 9)

    def shrunk(level: DataFrame) -> DataFrame:
        m = F.lit(_strength(level))
        a, b = m * F.col("parent") + F.col("bad"), m * (1 - F.col("parent")) + F.col("n") - F.col("bad")
        rate = a / (a + b)
        # What isn't known about the parent isn't known here either, as far as the prior counts.
        var = rate * (1 - rate) / (a + b + 1) + F.pow(m / (m + F.col("n")), 2) * F.col("parent_var")
        return checkpointed(level.select("*", F.round(rate, 9).alias("rate"), F.round(var, 12).alias("var")).withColumn("lower", bound))

    # The whole: a uniform prior.
    a, b = 1 + F.col("bad"), 1 + F.col("n") - F.col("bad")
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    one = checkpointed(whole.select("n", "bad", F.round(a / (a + b), 9).alias("rate"), F.round(a * b / ((a + b) * (a + b) * (a + b + 1)), 12).alias("var")).withColumn("lower", bound))
    top = one.first()
    above = lambda df, key: df.select(key, F.col("rate").alias("parent"), F.col("var").alias("parent_var"))
    suffix = shrunk(suffixes.withColumns({"parent": F.lit(top.rate), "parent_var": F.lit(top["var"])}))
    domain = shrunk(_looked_up(domains, above(suffix, "suffix"), "suffix"))
    host = shrunk(_looked_up(hosts, above(domain, "domain"), "domain"))
    out = lambda level, df, name: df.select(F.lit(level).alias("level"), name.alias("name"), "n", "bad", "rate", "lower")
    return out("host", host, F.col("host")).union(out("domain", domain, F.col("domain"))).union(out("suffix", suffix, F.col("suffix"))).union(out("all", one, F.lit("")))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_lower. ``labels``: page_id and bad (0 or 1)."""
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.filter("bad IN (0, 1) AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("of")).agg(F.max("bad").alias("bad"))
    rated = reputation(parsed.join(known, F.col("page_id") == F.col("of")).select("host", "bad"), z)
    # A row for each host first: the pages of a host, of a domain or of a suffix look up one row, and the whole is a constant.
    counted = checkpointed(parsed.groupBy("host").agg(F.count("*").alias("pages")))
    asked = counted.select("host", "pages", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    for level in ("host", "domain", "suffix"):
        of = rated.filter(F.col("level") == level).select(F.col("name").alias(level), F.col("rate").alias(f"{level}_rate"), F.col("lower").alias(f"{level}_lower"))
        asked = _looked_up(asked, of, level) if level != "host" else asked.join(of, level, "left")
    whole = rated.filter("level = 'all'").first()
    of = lambda c: F.coalesce(*(f"{level}_{c}" for level in ("host", "domain", "suffix")), F.lit(whole[c])).alias(f"bad_{c}")
    best = checkpointed(asked.select(F.col("host").alias("at"), "pages", of("rate"), of("lower")))
    total = counted.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    often = F.col("pages") * HOT_NAMES > total
    marked = parsed.join(F.broadcast(best.filter(often).drop("pages")), F.col("host") == F.col("at"), "left")
    rest = marked.filter("at IS NULL").drop("at", "bad_rate", "bad_lower").join(best.filter(~often).drop("pages"), F.col("host") == F.col("at"), "left")
    met = marked.filter("at IS NOT NULL").unionByName(rest).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_lower") > threshold, "block").otherwise("allow")
    return met.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "bad_rate", "bad_lower")
