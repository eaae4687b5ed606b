from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import index, memory, vectors

NOW = datetime(2024, 2, 1)
FIELDS = "user_id string, key string, kind string, embedding array<double>, updated_at timestamp, recall_count int"


def outcomes(spark, rows, **limits):
    items = spark.createDataFrame(rows, FIELDS)
    return {r.key: r.outcome for r in memory.prune(items, F.lit(NOW), **limits).collect()}


def topic(key, place, recalled=0, days=0, also=0.0):
    v = [0.0] * 8
    v[place] = 1.0
    v[(place + 1) % 8] = also
    return ("u", key, "topic", v, NOW - timedelta(days=days), recalled)


def profile(key, days=0):
    return ("u", key, "profile", None, NOW - timedelta(days=days), 0)


def test_valued_topics_stay_at_the_cap(spark):
    got = outcomes(spark, [topic("valuable", 0, 6), *(topic(f"noise-{i}", i + 1) for i in range(5))], cap=3, margin=0)
    assert sorted(got.values()) == ["evicted"] * 3 + ["kept"] * 3 and got["valuable"] == "kept"


def test_a_user_is_never_emptied(spark):
    assert list(outcomes(spark, [topic(f"t{i}", i) for i in range(4)], cap=1, margin=0).values()).count("kept") == 1


def test_several_profiles_become_one(spark):
    assert outcomes(spark, [profile("a", 3), profile("b", 1)], cap=30, margin=10) == {"a": "merged", "b": "kept"}


def test_a_sole_profile_stays(spark):
    got = outcomes(spark, [profile("only", 900), *(topic(f"t{i}", i) for i in range(5))], cap=2, margin=0)
    assert got["only"] == "kept" and list(got.values()).count("kept") == 3


def test_the_most_recalled_of_similar_topics_stays(spark):
    got = outcomes(spark, [topic("dup", 0, 1, also=0.3), topic("valuable", 0, 5), topic("other", 4)], cap=2, margin=0)
    assert got == {"valuable": "kept", "dup": "duplicate", "other": "kept"}


def test_small_users_keep_all(spark):
    assert set(outcomes(spark, [profile("p"), topic("a", 0), topic("b", 0)], cap=30, margin=10).values()) == {"kept"}
    assert outcomes(spark, [], cap=1, margin=0) == {}


def greedy(rows, threshold):
    seed = {}
    for user, key, v in sorted(rows):
        if (user, key) not in seed:
            for u, k, w in rows:
                close = u == user and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= threshold if np.any(v) and np.any(w) else False
                if (u, k) not in seed and (k == key and u == user or close):
                    seed[u, k] = key
    return seed


@pytest.mark.parametrize("block", [4, 2048])
def test_clusters_and_pairs_against_loops(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(u, int(k), [float(x) for x in np.round(rng.normal(size=2), 1)]) for u in range(3) for k in range(25)] + [(0, 100, [0.0, 0.0]), (1, 101, [1.0, 0.0, 0.0])]
    rows = [(u, k, v if len(v) == 2 else [*v]) for u, k, v in rows]
    items = spark.createDataFrame(rows, "user_id long, key long, embedding array<double>")
    flat = [(u, k, np.array(v)) for u, k, v in rows if len(v) == 2]
    want = greedy(flat, 0.88) | {(1, 101): 101}
    assert {(r.user_id, r.key): r.seed for r in memory.clusters(items).collect()} == want
    pairs = {(r.user_id, r.a, r.b) for r in vectors.similar_pairs(items, 0.88).collect()}
    reps = {}
    for u, k, v in flat:
        reps.setdefault((u, tuple(v)), k)
    assert pairs == {(u, min(a, b), max(a, b)) for (u, v), a in reps.items() for (w, x), b in reps.items() if u == w and a < b and any(v) and any(x) and np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x) >= 0.88}


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    data = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", F.col("label").alias("user_id"))
    rows = data.collect()
    unit = np.array([r.embedding for r in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids, users = np.array([r.vec_id for r in rows]), np.array([r.user_id for r in rows])
    asked = data.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "user_id")
    for within in ((), ("user_id",)):
        got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(data, asked, 8, within=within).collect()}
        for q in np.flatnonzero(ids % 20 == 0):
            near = [i for i in np.argsort(-(unit @ unit[q]), kind="stable") if not within or users[i] == users[q]][:8]
            assert [got[ids[q], n + 1] for n in range(8)] == [ids[i] for i in near]
    exact = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(data, asked, 8).collect()}
    built = index.VectorIndex.fit(data)
    assert {(r.query_id, r["rank"]): r.vec_id for r in built.search(asked, 8).collect()} == exact


def grouped(spark, n, groups, dims=16, spread=0.05, seed=1):
    """vec_id, embedding about so many centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    made = centres[np.arange(n) % groups] + spread * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(made)], "vec_id long, embedding array<double>")


def test_index_visits_few_lists_of_clustered_vectors(spark, tmp_path):
    data = grouped(spark, 3000, 40)
    asked = data.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(data, asked, 8).collect()}
    built = index.VectorIndex.fit(data, sample=1500)
    assert {(r.query_id, r["rank"]): r.vec_id for r in built.search(asked, 8).collect()} == exact
    assert built.visited(asked, 8) < 0.1
    few = {(r.query_id, r.vec_id) for r in built.search(asked, 8, most_lists=2).collect()}
    assert len(few & {(q, v) for (q, _), v in exact.items()}) >= 0.9 * len(exact)
    built.write(str(tmp_path / "index"))
    again = index.VectorIndex.read(spark, str(tmp_path / "index"))
    assert {(r.query_id, r["rank"]): r.vec_id for r in again.search(asked, 8).collect()} == exact


def test_index_of_few_or_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.1]), (8, [0.0, 0.0]), (9, None)], "query_id long, query_vec array<double>")
    found = index.VectorIndex.fit(data).search(asked, 9).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(7, 1, 1), (7, 2, 4), (7, 3, 4), (7, 4, 5)]
    assert index.VectorIndex.fit(data.limit(0)).search(asked, 3).collect() == []


def test_similar_pairs_of_a_large_user_meet_in_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 60)
    items = grouped(spark, 1200, 30).select(F.lit(1).alias("user_id"), F.col("vec_id").alias("key"), "embedding")
    items = items.union(items.filter("key < 40").withColumn("user_id", F.lit(2)))
    rows = items.collect()
    unit = np.array([r.embedding for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(rows[i].user_id, *sorted((rows[i].key, rows[j].key))) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.88, 1))) if rows[i].user_id == rows[j].user_id}
    assert {(r.user_id, r.a, r.b) for r in vectors.similar_pairs(items, 0.88).collect()} == want
    group = ["dims", "user_id"]
    pairs = vectors.block_pairs(vectors._cells(vectors._unit(items, "embedding"), group, "key"), group, 0.88).agg(F.count_if("near"), F.count("*")).first()
    assert pairs[0] < 0.6 * pairs[1]


def test_vectors_travel_by_wide_blocks(spark, monkeypatch):
    """Vectors without structure, of which no pair of blocks can be left out: copies of a vector are as many as its user's wide blocks, not as its blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "PAIRED", 200 * 6 * 8)
    monkeypatch.setattr(vectors, "SCORES", 700)
    x = np.random.default_rng(5).normal(size=(600, 6))
    items = spark.createDataFrame([(1 + (i % 40 == 0), i, v.tolist()) for i, v in enumerate(x)], "user_id long, key long, embedding array<double>")
    user = np.arange(600) % 40 == 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= 0.88, 1) & (user[:, None] == user)
    got = [(r.a, r.b) for r in vectors.similar_pairs(items, 0.88).collect()]
    assert sorted(got) == sorted(zip(*(k.tolist() for k in np.nonzero(near)))) and len(got) > 100
    group = ["dims", "user_id"]
    cells = vectors._cells(vectors._unit(items, "embedding"), group, "key")
    pairs = vectors.wide_pairs(cells, group, 0.88).filter("user_id = 1")
    either = pairs.select("*", F.explode(F.array("low", "high")).alias("own"))
    copies = lambda *at: either.select("own", *at).distinct().groupBy("own").count().agg(F.max("count")).first()[0]
    assert copies("wide_low", "wide_high") <= 3 < 20 < copies("low", "high")
