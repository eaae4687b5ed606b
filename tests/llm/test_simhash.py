import random
import re
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from corpuslake.llm import components, simhash
from corpuslake.llm.common import likely_in

DATA = "/root/testdata/sf0.001/documents.parquet"


def brute(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(ids, fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(set(fps), 2):
        if bin(a ^ b).count("1") <= radius:
            root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for f in fps]


def compare(docs):
    want = docs.select("doc_id", "text").collect()
    fps = [brute(r.text) for r in want]
    comps = groups([r.doc_id for r in want], fps)
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((str(r.doc_id), f, c) for r, f, c in zip(want, fps, comps))


def test_against_brute_force(spark):
    compare(spark.read.parquet(DATA))


def test_odd_rows(spark, odd, empty):
    compare(odd)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "None"]


def test_one_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "other words entirely here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 2]


def test_links_at_every_distance(spark):
    base = 0x0123456789ABCDEF
    flips = [base, base ^ 1, base ^ (1 << 63 | 2), base ^ 0b111, base ^ 0b11100000]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    found = {frozenset(map(int, r)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    comps = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want = groups(range(len(flips)), flips)
    for i, j in combinations(range(len(flips)), 2):
        assert (want[i] == want[j]) == (comps.get(signed[i], signed[i]) == comps.get(signed[j], signed[j]))
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in map(tuple, found))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 1999), (1999, 2000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 1000 for i in range(1001, 1100)) and got[2000] == 1999
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert simhash.fingerprints(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("A").alias("text"))).first().fp & (1 << 64) - 1 == brute("a")


def test_edited_copies(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(400)]
    edits = lambda n: " ".join("new" + w if i % (400 // n) == 7 else w for i, w in enumerate(words))
    mixed = words[:]
    rng.shuffle(mixed)
    other = " ".join(f"v{rng.randrange(3000)}" for _ in range(400))
    rows = [(9, " ".join(words)), (3, edits(2)), (4, edits(4)), (5, edits(40)), (6, " ".join(mixed)), (7, other), (8, " ".join(words).upper())]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7]  # 40 edits leave a similarity of a third


def kept_by_brute_force(rows):
    """The doc_ids that stay of (doc_id, text): the least of each component of texts at a similarity of 0.8 of their five-word shingles."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(least.values())


def form_letters(n, edited=()):
    """Texts of 60 shared words and three slots of 30 fillings of five words each: none has a similarity of 0.8 to another, but for copies with an edit."""
    rng, rows = random.Random(n), []
    for i, c in enumerate(rng.sample(range(27_000), n)):
        words = [f"b{k}" for k in range(60)]
        for slot, filling in enumerate((c % 30, c // 30 % 30, c // 900)):
            at = 15 + 20 * slot
            words[at:at] = [f"s{slot}v{filling}w{k}" for k in range(5)]
        rows.append((2 * i, " ".join(words)))
        if i in edited:
            rows.append((2 * i + 1, " ".join([*words[:-1], "edit"])))
    return rows


def test_rows_grow_with_form_letters_not_with_their_pairs(spark, monkeypatch):
    seen = {}

    def counting(name, f):
        def run(*args):
            made = f(*args)
            seen.setdefault(name, []).append(made.count())
            return made

        monkeypatch.setattr(simhash, name, run)

    for name in ("_rare_first", "_pairs", "_atoms"):
        counting(name, getattr(simhash, name))
    for n in (250, 1000):
        rows = form_letters(n, range(5))
        kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 2 * n, 2))
    for small, large in seen.values():
        assert large < 6 * small and large < 20 * 1000


def test_links_across_groups_in_blocks(spark, monkeypatch):
    """Chains of texts of which only neighbours are alike, among form letters: the first owner of a shingle links few of them."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 900)
    rng = random.Random(2)
    rows = form_letters(60, range(10))
    for c in range(3):
        words = [f"c{c}w{k}" for k in range(100)]
        for i in range(25):
            rows.append((10_000 + 100 * c + i, " ".join(words)))
            at = rng.randrange(0, 98)
            words[at : at + 2] = [f"n{rng.randrange(10**6)}" for _ in range(2)]
    want = kept_by_brute_force(rows)
    assert 60 <= len(want) < 90
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_copies_among_texts_with_a_hot_line(spark):
    rng = random.Random(8)
    line = " ".join(f"hot{i}" for i in range(13))
    body = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(60):  # the repeated line decides all fingerprints of word pairs; the shingle sets differ
        words = body(60)
        rows.append((3 * i, " ".join([line] * 40 + words)))
        if i % 3 == 0:
            rows.append((3 * i + 1, " ".join([line] * 40 + words[:30] + ["edit"] + words[31:])))
    base = body(200)
    for i in range(40):  # one group: like its base, less like each other
        words = base[:]
        for at in rng.sample(range(200), 4):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(rows)


def test_long_copies_near_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):  # 1000 words; 22 and 25 edits leave similarities of about 0.80 and 0.78
        words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
        rows.append((2 * i, " ".join(words)))
        for at in range(20, 1000, 1000 // (22 if i % 2 else 25)):
            words[at] = "new" + words[at]
        rows.append((2 * i + 1, " ".join(words)))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    want = kept_by_brute_force(rows)
    assert 70 < len(want) < 110
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_one_of_each_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = kept_by_brute_force(rows)
    assert len(want) < len(rows) - 50
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == want


def test_filter_by_likely_keys(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"), "id")
    wanted = keys.filter("id % 7 = 0").select("k")
    hit = {r.id for r in likely_in(keys, "k", wanted).collect()}
    miss = {r.id for r in likely_in(keys, "k", wanted, False).collect()}
    assert hit | miss == set(range(5000)) and not hit & miss
    assert set(range(0, 5000, 7)) <= hit and len(hit) < 800
    assert likely_in(keys, "k", wanted.limit(0)).count() == 0
