"""Vector queries do their whole jobs."""

import numpy as np
from pyspark.sql import functions as F
from twins import DATA, connection, same

from corpuslake import plans
from corpuslake.operators import index, vectors
from corpuslake.operators.vectors import cosines


def test_v1_is_the_whole_product(spark):
    con = connection()
    asked, stored = con.sql("SELECT count(*) FILTER (vec_id % 20 = 0), count(*) FROM embeddings").fetchall()[0]
    got = plans.QUERIES["v1_cosine"](spark, DATA).toPandas()
    assert len(got) == asked * stored
    same(got, con.sql(plans.ORACLE_SQL["v1_cosine"]).df())


def test_cosines_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("corpuslake.operators.vectors.BLOCK", 3)
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)] + [(10, [0.0, 0.0]), (11, None)], "key long, embedding array<float>")
    asked = spark.createDataFrame([(i, [1.0, float(-i)]) for i in range(7)], "query_id long, query_vec array<float>")
    got = {(r.query_id, r.key): r.similarity for r in cosines(items, asked, "key").collect()}
    assert len(got) == 7 * 12
    assert got[0, 0] == 1 and got[3, 10] is None and got[3, 11] is None
    assert abs(got[2, 2] + 0.6) < 1e-12


def test_an_index_without_structure_lets_whole_blocks_meet(spark, monkeypatch):
    """Vectors that lists can't part: every list would be sent every query, so none but the first pass is."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(900)] + [(900, [0.0] * 24)]
    rows += [(901 + i, rows[i][1]) for i in range(5)]  # copies tie
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = items.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vec")
    built = index.VectorIndex.fit(items)
    probes, sent = built._probes, []

    def seen(queries, k, most_lists):
        out = probes(queries, k, most_lists)
        sent.append("reached" in queries.columns)
        return out

    monkeypatch.setattr(built, "_probes", seen)
    got = {(r.query_id, r["rank"]): r.vec_id for r in built.search(asked, 8).collect()}
    assert sent == [False]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    kept = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
    unit = x[kept] / np.linalg.norm(x[kept], axis=1, keepdims=True)
    want = {}
    for q in range(0, 900, 20):
        scores = np.round(unit @ unit[q], 12)
        for rank, at in enumerate(np.lexsort((kept, -scores))[:8]):
            want[q, rank + 1] = kept[at]
    assert got == want


def test_best_of_a_block():
    scores = np.array([[1.0, 3.0, 3.0, 3.0], [np.nan, 0.5, 2.0, 0.5]])
    rows, columns, best = vectors._best_of(scores, 2, 10)
    assert list(zip(rows, columns, best)) == [(10, 1, 3.0), (10, 2, 3.0), (11, 2, 2.0), (11, 1, 0.5)]
    assert np.isnan(vectors._best_of(np.array([[np.nan, 1.0]]), 5, 0)[2]).tolist() == [False, True]


def test_cosines_are_products_of_blocks(spark):
    """Pairs are multiplied as matrices, not joined and worked out one by one; vectors of other lengths, without a length or with null components give null."""
    stored = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [3.0, 4.0])]
    items = spark.createDataFrame(stored, "key long, embedding array<double>")
    made = cosines(items, items.select(F.col("key").alias("query_id"), F.col("embedding").alias("query_vec")), "key")
    assert "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.key): r.similarity for r in made.collect()}
    assert len(got) == 36
    assert {k: round(s, 9) for k, s in got.items() if s is not None} == {(1, 1): 1.0, (1, 6): 0.6, (6, 1): 0.6, (6, 6): 1.0, (3, 3): 1.0}
