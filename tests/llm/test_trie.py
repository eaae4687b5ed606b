"""The prefix trie against a plain version, with chains ranked in one task and by joins, and conversations over many ranges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpuslake.llm import trie
from corpuslake.llm.ranges import previous, ranged, running

COLUMNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """(conv_id, depth): parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key = lambda r, t: (hashlib.md5(f"{len(r or '')}/{r or ''}{t or ''}".encode()).digest(), r or "", t or "")
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, *key(role, text)))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - (abs(c) % 100) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(own.get(lead, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    made = {}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        below = [made[members[q][0], len(q)] for q in children[p]]
        size = len(p[-1][1]) if p else 0
        ends = ",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p))
        made[members[p][0], len(p)] = (members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), sum(b[3] for b in below) or 1, (len(members[p]) - 1) * size + sum(b[4] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return made


def found(df):
    rows = df.collect()
    made = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(made) == len(rows)
    return made, rows


def tree(spark, rows, columns=COLUMNS, **how):
    df = spark.createDataFrame(rows, columns).repartition(3)
    return trie.prefix_tree(*trie.spliced(trie.numbered(df)), **how)


def some(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 700), n):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "ä€", "what now", "x" * 50])))
    return rows


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"local": 7}), (3, {"local": 1})])
def test_trie_against_plain_version(spark, seed, how):
    rows = some(seed, 60)
    made, nodes = found(tree(spark, rows, **how))
    assert made == plain(rows)
    assert sorted(x for r in nodes for x in (r.enter, r.leave)) == list(range(2 * len(nodes)))


def test_one_long_conversation_and_many_alike(spark):
    """One conversation of a third of all rows, and a third that are the same."""
    rows = [(7, i, "user", f"turn {i}") for i in range(3000)]
    rows += [(1000 + c, i, "user", "same") for c in range(500) for i in range(6)]
    rows += [(5000 + c, 0, "user", str(c)) for c in range(300)]
    made, _ = found(tree(spark, rows, local=500))
    assert made == plain(rows)


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = [(c, 0, "user", "a") for c in range(1, 100, 3)] + some(5, 20)
    assert found(tree(spark, rows))[0] == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x", "p"), (1, None, None, None, "p"), (1, None, None, None, "p"), (1, 2, "user", "y", "p"), (101, 2, "user", "y", "p"), (300, 1, None, "z", "p"), (-5, 1, "u", "z", "p")]
    assert found(tree(spark, rows, COLUMNS + ", part string"))[0] == plain(rows)
    assert tree(spark, [], COLUMNS).collect() == []


def test_sums_and_rows_before_run_through_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 2, 2, 2, 3, 9]), i, rng.randrange(-(1 << 62), 1 << 62)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(4)
    dealt = ranged(df, "k", "i", parts=13)
    assert dealt.select("part").distinct().count() > 5
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    want, sums, last = {}, defaultdict(int), None
    for k, i, v in sorted(rows):
        want[i] = (wrap(sums[k]), wrap(sums[k] + v), last)
        sums[k] += v
        last = i
    got = {r.i: (r.v_before, r.v_sum) for r in running(dealt, "k", ["v"]).collect()}
    assert got == {i: x[:2] for i, x in want.items()}
    assert {r.i: r.last_i for r in previous(dealt, ["i"]).collect()} == {i: x[2] for i, x in want.items()}
