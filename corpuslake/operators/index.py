"""An inverted-file index of vectors: lists about centroids, searched from the nearest on until no other can hold a better one.

Centroids are fitted by k-means on a bounded sample; every vector goes to the list of its nearest centroid. Angles obey the triangle inequality: a vector in a list
whose farthest member is r from the centroid is no nearer to a query than the query's angle to that centroid less r. So a first pass over the nearest lists that hold k
vectors bounds the k-th best angle, and a second one over the lists that the bound leaves makes the answer exact. On clustered vectors these are few;
without structure they are nearly all. Then whole blocks meet instead, as a query would be sent to each list, or a search may stop at a number of lists (``most_lists``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions.values import norm
from corpuslake.operators import vectors
from corpuslake.sources.scratch import checkpointed

#: Vectors that centroids are fitted on, at most, and lists, at most: what tasks hold is MOST_LISTS centroids.
SAMPLE, MOST_LISTS = 50_000, 4096
#: Angles are compared with this much to spare for rounding.
SPARE = 1e-6
#: From this share of all pairs on, a search lets whole blocks meet.
WHOLE = 0.2


def _units(batch: pa.RecordBatch, column: str) -> np.ndarray:
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


class VectorIndex:
    """``table``: key, embedding, list, angle (to the list's centroid). ``centroids``: a row a list, unit vectors."""

    def __init__(self, table: DataFrame, centroids: np.ndarray, key: str):
        self.table, self.centroids, self.key = table, centroids, key

    @classmethod
    def fit(cls, items: DataFrame, lists: int | None = None, key: str = "vec_id", sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """Index all of ``items`` (key, embedding) that have a length; all have as many components. Repeated rows are indexed as often; by default
        there are as many lists as the square root of the rows."""
        usable = items.select(key, "embedding").filter(norm(F.col("embedding")) > 0)
        rows = usable.count()
        lists = max(1, min(MOST_LISTS, lists or round(rows**0.5)))
        if not rows:
            return cls(usable.withColumns({"list": F.lit(0), "angle": F.lit(0.0)}), np.zeros((1, 1)), key)
        some = usable if rows <= sample else usable.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(int(sample / rows * (1 << 20))))
        fitted = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=10).fit(some.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))
        centroids = np.array(fitted.clusterCenters())
        centroids = centroids[np.linalg.norm(centroids, axis=1) > 0]
        centroids = centroids / np.linalg.norm(centroids, axis=1, keepdims=True)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    angles = _angles(_units(batch, "embedding"), centroids)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(angles.min(axis=1))], [*batch.schema.names, "list", "angle"])

        kinds = ", ".join(f"{n} {t}" for n, t in usable.dtypes)
        return cls(checkpointed(usable.mapInArrow(assign, f"{kinds}, list int, angle double")), centroids, key)

    def write(self, path: str) -> None:
        """Keep the index: a folder a list, and the centroids beside them."""
        spark = self.table.sparkSession
        self.table.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str = "vec_id") -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
        return cls(spark.read.parquet(f"{path}/lists"), np.array([r.centroid for r in rows]), key)

    @cached_property
    def _lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, farthest angle) of each list."""
        sizes, radii = np.zeros(len(self.centroids), dtype=np.int64), np.zeros(len(self.centroids))
        for r in self.table.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # a row a list
            sizes[r.list], radii[r.list] = r.n, r.radius
        return sizes, radii

    def _lists_of(self, batch: pa.RecordBatch, k: int, most_lists: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(lists, wanted) of each query, nearest lists first: without ``reached`` (an angle) those that together hold k vectors are wanted, with it
        the others that may hold a vector within it."""
        sizes, radii = self._lists
        angles = _angles(_units(batch, "query_vec"), self.centroids)
        order = np.argsort(angles, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        wanted = (held - sizes[order] < k) & (sizes[order] > 0)
        if "reached" in batch.schema.names:
            reached = batch.column("reached").to_numpy(zero_copy_only=False)[:, None]
            near = np.take_along_axis(angles, order, axis=1) - radii[order] <= reached + SPARE
            wanted = ~wanted & (sizes[order] > 0) & near
        if most_lists is not None:
            wanted &= np.cumsum(sizes[order] > 0, axis=1) <= most_lists
        return order, wanted

    def _runner(self) -> VectorIndex:
        """What tasks need: the centroids, and the sizes and radii of their lists."""
        bare = VectorIndex(None, self.centroids, self.key)
        bare._lists = self._lists
        return bare

    def _probes(self, queries: DataFrame, k: int, most_lists: int | None) -> DataFrame:
        """query_id, query_vec, list: the wanted lists (``_lists_of``) of each query."""
        of = self._runner()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and of._lists[0].any():
                    order, wanted = of._lists_of(batch, k, most_lists)
                    row, at = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), batch.column("query_vec").take(pa.array(row)), pa.array(order[row, at].astype(np.int32))], ["query_id", "query_vec", "list"])

        kinds = dict(queries.dtypes)
        return queries.mapInArrow(run, f"query_id {kinds['query_id']}, query_vec {kinds['query_vec']}, list int")

    def _share(self, queries: DataFrame, k: int, most_lists: int | None) -> float:
        """Share of all pairs of a query and a vector that the queries' wanted lists hold; nothing but sums leaves the tasks."""
        of = self._runner()
        stored = int(of._lists[0].sum())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and stored:
                    order, wanted = of._lists_of(batch, k, most_lists)
                    met = int((of._lists[0][order] * wanted).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([batch.num_rows * stored])], ["met", "pairs"])

        met, pairs = queries.mapInArrow(run, "met long, pairs long").agg(F.sum("met"), F.sum("pairs")).first()
        return (met or 0) / (pairs or 1)

    def _first(self, queries: DataFrame, k: int, most_lists: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(the probes of the first pass, their k best, the queries with the angle that the k-th best reached)."""
        asked = queries.select("query_id", "query_vec").filter(norm(F.col("query_vec")) > 0)
        first = checkpointed(self._probes(asked, k, most_lists))
        best = checkpointed(vectors.nearest(self.table, first, k, self.key, ("list",)))
        # A query that has met fewer than k may be near to anything.
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("similarity"))))).otherwise(F.lit(4.0)).alias("reached"))
        return first, best, asked.join(kth, "query_id")

    def probes(self, queries: DataFrame, k: int, most_lists: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(the probes (query_id, query_vec, list) that a search by lists makes, the best that they find)."""
        first, best, asked = self._first(queries, k, most_lists)
        later = checkpointed(self._probes(asked, k, most_lists))
        return first.union(later), best.unionByName(vectors.nearest(self.table, later, k, self.key, ("list",)))

    def search(self, queries: DataFrame, k: int, most_lists: int | None = None) -> DataFrame:
        """query_id, rank, key, similarity: the k vectors most like each query (query_id, query_vec) by cosine, ties by key: exactly, unless ``most_lists``
        stops a query at so many of its nearest lists. Queries without a length find nothing."""
        _, best, asked = self._first(queries, k, most_lists)
        asked = checkpointed(asked)
        if most_lists is None and self._share(asked, k, None) >= WHOLE:
            return vectors.nearest(self.table, asked, k, self.key)
        later = checkpointed(self._probes(asked, k, most_lists))
        best = best.unionByName(vectors.nearest(self.table, later, k, self.key, ("list",)))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), self.key))
        return best.withColumn("rank", order).filter(F.col("rank") <= k)

    def visited(self, queries: DataFrame, k: int, most_lists: int | None = None) -> float:
        """Share of all pairs of a query and a vector that a search compares."""
        sizes = self.table.groupBy("list").agg(F.count("*").alias("n"))
        met = self.probes(queries, k, most_lists)[0].join(F.broadcast(sizes), "list").agg(F.sum("n")).first()[0] or 0
        return met / max(1, queries.count() * self.table.count())
