"""Decontamination against a plain version: short items, repeated ids, slices of the benchmark, colliding hashes, and cut texts."""

import random
import re

import numpy as np
import pytest

from corpuslake.llm import decontaminate

WORD = re.compile(decontaminate.WORD)


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, n=10):
    w = words(text)
    hit, met = set(), set()
    for item, t in items:
        x = words(t)
        size = min(n, len(x))
        grams = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1 if x else 0):
            if tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                met |= {str(item)} - {"None"}
    return len(w), hit, sorted(met)


def case(seed, vocabulary=6, n_docs=60):
    rng = random.Random(seed)
    vocab = ["the", "Ünïcode", "a1", "THE", "end.", "x-y", "Ä", "z"][:vocabulary]
    text = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(k))
    items = [(i // 2 if i % 5 else None, text(rng.choice([0, 1, 3, 6, 9, 14]))) for i in range(14)] + [(99, None), (98, "...")]
    docs = [(i, text(rng.randrange(60))) for i in range(n_docs)] + [(None, text(30)), (1, None), (2, ""), (3, " .,")]
    return docs + docs[:3], items


def scanned(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return decontaminate.scan(d, b, **how).selectExpr("row.doc_id", "row.text", "n_words", "spans", "items").collect()


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"most_chars": 60}), (3, {"n": 3}), (4, {"n": 4, "most_chars": 1})])
def test_scan_against_plain_version(spark, seed, how):
    docs, items = case(seed)
    got = scanned(spark, docs, items, **how)
    assert len(got) == len(docs)
    assert any(r.spans for r in got)
    for r in got:
        n, hit, met = plain(r.text, items, how.get("n", 10))
        assert r.n_words == n
        assert {i for s in r.spans for i in range(s.start, s.end)} == hit
        assert sum(s.end - s.start for s in r.spans) == len(hit)
        assert r.items == met


def test_collisions_never_count(monkeypatch):
    monkeypatch.setattr(decontaminate, "_hashed", lambda columns: np.zeros(len(columns[0]), dtype=np.uint64))
    docs, items = case(5)
    index = decontaminate.Index([(str(i), " ".join(words(t))) for i, t in items if words(t) and i is not None], 3)
    for _, text in docs:
        hit, met = set(), set()
        for size, starts, which in index.hits(index.ids(text)):
            hit |= {s + j for s in starts.tolist() for j in range(size)}
            met |= {index.names[i] for i in which.tolist()}
        assert (hit, sorted(met)) == plain(text, [x for x in items if x[0] is not None], 3)[1:]


def test_long_items_are_cut_into_pieces_that_overlap(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 5)
    long = " ".join(f"w{i}" for i in range(203))
    docs = [(i, " ".join(f"w{j}" for j in range(i, min(203, i + 12)))) for i in range(203)]
    for r in scanned(spark, docs, [(1, long)], most_chars=200):
        assert sum(s.end - s.start for s in r.spans) == (r.n_words if r.n_words >= 10 else 0)


def test_long_texts_are_read_in_slabs(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLAB", 7)
    index = decontaminate.Index([("1", "a b c")], 10)
    assert [index.vocab.get(w.encode(), -1) for w in words("x A b;c " * 50)] == index.ids("x A b;c " * 50).tolist()
    assert [s.tolist() for _, s, _ in index.hits(index.ids("x A b;c " * 3))] == [[1, 5, 9]]


def test_hits_are_cut_out_or_documents_dropped(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"Before it: W0, {item[3:]}! And after.", 7, "x"), (2, "clean text", 10, "x"), (3, None, None, None), (4, item, 1, "x"), (4, item, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_chars, r.spans) for r in decontaminate.without_hits(docs, bench).collect())
    assert got == [(1, "Before it: ! And after.", 23, "x"), (2, "clean text", 10, "x"), (3, None, None, None), (4, "", 0, "x"), (4, "", 0, "x")]
    assert sorted(r.doc_id for r in decontaminate.without_hits(docs, bench, whole=True).collect()) == [2, 3]


def test_empty_tables_and_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string")
    none = bench.limit(0)
    assert decontaminate.scan(empty, bench).collect() == []
    assert {tuple(r.items) for r in decontaminate.scan(odd, none).collect()} == {()}
    got = decontaminate.scan(odd, bench).selectExpr("row.doc_id", "size(items) AS n").collect()
    assert len(got) == odd.count()
    assert sorted(r.doc_id for r in got if r.n) == [1, 1, 7]
