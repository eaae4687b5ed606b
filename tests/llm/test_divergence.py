"""The audit against a plain version: colliding digests, several tiles, ties at the last rank, small tasks."""

import random
import re
from collections import Counter, defaultdict

import pytest

from corpuslake.llm import divergence

WORD = re.compile(divergence.WORD)
COLUMNS = "text string, lang string, source string"


def plain(rows, least_docs=3, top=200):
    docs = defaultdict(list)
    for text, lang, source, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or ""].append((source or "", Counter(WORD.findall(low))))
    made = []
    for lang, of in docs.items():
        seen = Counter(t for _, c in of for t in c)
        kept = {t for t, n in seen.items() if n >= least_docs}
        groups = {s: Counter() for s, _ in of}
        for s, c in of:
            groups[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(groups.values(), Counter())
        rate = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        rates = {s: {t: rate(c, t) for t in kept} for s, c in groups.items()}
        of_lang = {t: rate(whole, t) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s, p in rates.items():
            pairs = [(sum(f(p[t], q[t]) for t in kept), o) for o, q in rates.items() if o != s]
            terms = [(f(p[t], of_lang[t]), t) for t in kept if groups[s][t] and p[t] > of_lang[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                made += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(made)


def case(seed, n=120):
    rng = random.Random(seed)
    vocab = [rng.choice(["ab", "Ab", "ñu", "ß", "e", "xyz", "Ω", "日本"]) + rng.choice(["", "a", "b", "c", "q", "é"]) for _ in range(40)]
    return [(rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else " ".join(rng.choices(vocab[: rng.choice([5, 40])], k=rng.randrange(40))) + "., 5x", rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "s3", None, "s10"])) for _ in range(n)]


def audited(spark, rows, columns=COLUMNS, **how):
    found = divergence.audit(spark.createDataFrame(rows, columns).repartition(3), **how)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"bits": 0}), (3, {"bits": 4, "tile": 2}), (4, {"tile": 1, "top": 3})])
def test_audit_against_plain_version(spark, seed, how):
    rows = case(seed)
    assert audited(spark, rows, **how) == plain(rows, top=how.get("top", 200))


def test_ties_at_the_last_rank(spark):
    """Many terms with one value, more than are listed."""
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(" ".join(names[i::2]), "en", f"s{i}") for i in (0, 1) for _ in range(3)]
    assert audited(spark, rows, top=7) == plain(rows, top=7)
    assert audited(spark, rows, top=50) == plain(rows, top=50)


def test_tasks_that_write_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLAB", 16)
    counts = divergence._Counts(64)
    rows, most = case(6, 30), []
    groups = {g: i * 7 - 3 for i, g in enumerate(sorted({(lang or "", source or "") for _, lang, source in rows}))}
    for text, lang, source in rows:
        counts.add(groups[lang or "", source or ""], text or "")
        if counts.size > 40:
            most += counts.rows(8)
    most += counts.rows(8)
    n, docs = Counter(), Counter()
    for b in most:
        for r in b.to_pylist():
            for g, k, d in zip(r["groups"], r["n"], r["docs"], strict=True):
                n[g, r["term"]] += k
                docs[g, r["term"]] += d
    for text, lang, source in rows:
        for t, k in Counter(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))).items():
            n[groups[lang or "", source or ""], t] -= k
            docs[groups[lang or "", source or ""], t] -= 1
    assert not any(n.values()) and not any(docs.values())


def test_rates_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._rate(F.lit(9_000_000_000_000), F.lit(10_000_000_000_000), F.lit(7))).first()
    assert row[0] == 1 + 1_000_000_000 * 9_000_000_000_001 // 10_000_000_000_007


def test_odd_rows_and_empty_tables(spark, odd, empty):
    assert divergence.audit(empty).collect() == []
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd).collect()) == plain(rows)
    one = [("a b c", "en", "s")] * 3
    assert audited(spark, one) == plain(one)
