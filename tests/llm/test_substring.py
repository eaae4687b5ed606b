import hashlib
import random
import re
from collections import Counter

import pytest

from corpuslake.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, length):
    lists = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def compare(spark, rows, length=35, seed=8):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.row.doc_id), r.cut.n_words, r.cut.n_removed, r.cut.kept) for r in substring.without_repeats(docs, length, seed).collect())
    want = sorted((str(i), *b) for (i, _), b in zip(rows, brute([t for _, t in rows], length)))
    assert got == want


@pytest.mark.parametrize("n", range(3))
def test_random_texts(spark, n):
    rng = random.Random(n)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.randrange(8, 30))] for _ in range(6)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 20))]
        rows.append((i, " ".join(words)))
    compare(spark, rows + rows[:5], 12, 4)


def test_edges(spark):
    a, b = [f"a{i}" for i in range(35)], [f"b{i}" for i in range(34)]
    rows = [(1, " ".join(a)), (2, "x " + "\n".join(a) + " y"), (3, " ".join(b)), (4, " ".join(b)), (5, " ".join(["same"] * 36)), (6, None), (7, ""), (None, " ".join(a[:34])), (8, " ".join(b + b[:1])), (9, " ".join(["z"] + b + b[:1]))]
    compare(spark, rows)


def test_odd_rows(odd, empty):
    rows = substring.without_repeats(odd).collect()
    assert len(rows) == odd.count() and set(rows[0].row.asDict()) == set(odd.columns)
    assert {r.row.doc_id: r.cut.n_removed for r in rows}[4] == 30_000  # its words come round every 977
    assert substring.without_repeats(empty).count() == 0
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("steps", [1, 2, 50])
def test_any_number_of_steps_gives_the_same(spark, monkeypatch, steps):
    monkeypatch.setattr(substring, "STEPS", steps)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):  # one passage in contexts that agree for some words on either side
        left, right = [f"l{rng.randrange(2)}" for _ in range(12)], [f"r{rng.randrange(2)}" for _ in range(12)]
        cut = rng.randrange(5, 20)
        rows.append((i, " ".join(left + base[10 : 10 + cut] + right + [f"x{rng.randrange(10**6)}"])))
    compare(spark, rows, 14, 4)
