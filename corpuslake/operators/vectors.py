"""Exact vector search and joins, as products of blocks of vectors that Spark deals out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.values import norm
from corpuslake.sources.scratch import checkpointed

#: Vectors in a block, about; a task holds one block of either side and their product.
BLOCK = 2048
#: ``nearest`` keeps few rows of a product, so its blocks are so many times larger, and SPAN queries are scored at a time.
WIDE, SPAN = 4, 512
#: Vectors of a group that angles are measured to, and the steps of an angle that part its cells.
PIVOTS, STEP = 8, 0.1
#: Bytes of vectors, about, in a wide block of ``similar_pairs``, which is what travels, and the scores computed at a time there.
PAIRED, SCORES = 1 << 24, 1 << 21


def _unit(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``unit`` and its length ``dims``; vectors without a length, or with null components, are left out."""
    size = norm(F.col(column))
    return df.withColumn("_n", size).filter("_n > 0").withColumn("unit", F.transform(column, lambda x: x.cast("double") / F.col("_n"))).withColumn("dims", F.size(column)).drop("_n")


def _in_blocks(df: DataFrame, within: list[str], key: str, name: str, wide: int = 1) -> tuple[DataFrame, DataFrame]:
    """(``df`` with the number of its block, the number of blocks of each group)."""
    counts = df.groupBy(*within).agg(F.ceil(F.count("*") / (wide * BLOCK)).cast("int").alias(f"{name}s"))
    return df.join(counts, within).withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), counts


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _best_of(scores: np.ndarray, k: int, since: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows from ``since`` on, columns, scores) of each row's ``k`` best scores, ties by column; NaN is less than any."""
    odd = np.isnan(scores)
    scores[odd] = -np.inf
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    rows, columns = np.nonzero(scores >= least[:, None])
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    rows, columns = rows[first], columns[first]
    return rows + since, columns, np.where(odd[rows, columns], np.nan, scores[rows, columns])


def nearest(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", within: tuple[str, ...] = ()) -> DataFrame:
    """query_id, rank, ``key``, similarity: the ``k`` items most like each query by cosine, ties by key, of its own group where ``within`` names columns.

    Every block of queries meets every block of items in a task; a query's ``k`` best of each block are all that is shuffled again.
    Vectors of another length are never compared; those without a length take no part."""
    group = ["dims", *within]
    left, item_blocks = _in_blocks(_unit(items.select(key, *within, "embedding"), "embedding"), group, key, "item_block", WIDE)
    right, query_blocks = _in_blocks(_unit(queries.select("query_id", *within, "query_vec"), "query_vec"), group, "query_id", "query_block", WIDE)
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(query_blocks, group).select(*group, key, "unit", "item_block", to_all("query_blocks").alias("query_block"))
    right = right.join(item_blocks, group).select(*group, "query_id", "unit", "query_block", to_all("item_blocks").alias("item_block"))
    at = [*group, "item_block", "query_block"]
    # New names on this side, as both may stem from one table.
    right = right.select(*(F.col(c).alias(f"_{c}") for c in at), "query_id", "unit")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": b["query_id"].slice(0, 0), key: a[key].slice(0, 0), "similarity": pa.array([], pa.float64())})
        a = a.sort_by(key)
        stored, asked = _matrix(a["unit"]), _matrix(b["unit"])
        found = [_best_of(asked[s : s + SPAN] @ stored.T, k, s) for s in range(0, len(asked), SPAN)]
        rows, columns, scores = (np.concatenate(parts) for parts in zip(*found))
        return pa.table({"query_id": b["query_id"].take(rows), key: a[key].take(columns), "similarity": scores})

    kinds = dict(items.dtypes) | dict(queries.dtypes)
    found = left.groupBy(*at).cogroup(right.groupBy(*(f"_{c}" for c in at))).applyInArrow(best, f"query_id {kinds['query_id']}, {key} {kinds[key]}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vectors: their places, the matrix of them in double precision, and their norms. Null vectors and those with null components are left out."""
    flat = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)
    found = {}
    for dims in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == dims)
        values = flat.take(pa.array(places)).flatten()
        whole = ~pc.is_null(values).to_numpy(zero_copy_only=False).reshape(-1, dims).any(axis=1)
        rows = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)[whole]
        found[dims] = places[whole], rows, np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return found


def cosines(items: DataFrame, queries: DataFrame, key: str = "vec_id") -> DataFrame:
    """query_id, ``key``, similarity of every query (query_id, query_vec) with every item (``key``, embedding), null where either has no length.

    Every block of queries meets every block of items in a task of its own, which holds those two blocks and their product alone, whatever the tables' sizes."""
    left, item_blocks = _in_blocks(items.select(key, "embedding").withColumn("all", F.lit(0)), ["all"], key, "item_block")
    right, query_blocks = _in_blocks(queries.select("query_id", "query_vec").withColumn("all", F.lit(0)), ["all"], "query_id", "query_block")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(query_blocks, "all").select(key, "embedding", "item_block", to_all("query_blocks").alias("query_block"))
    right = right.join(item_blocks, "all").select("query_id", "query_vec", F.col("query_block").alias("_query_block"), to_all("item_blocks").alias("_item_block"))

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        scores, known = np.zeros((b.num_rows, a.num_rows)), np.zeros((b.num_rows, a.num_rows), dtype=bool)
        if a.num_rows and b.num_rows:
            stored, asked = _by_length(a["embedding"]), _by_length(b["query_vec"])
            for dims in stored.keys() & asked.keys():
                (columns, x, of_x), (rows, y, of_y) = stored[dims], asked[dims]
                sizes = np.outer(of_y, of_x)
                known[np.ix_(rows, columns)] = sizes != 0
                scores[np.ix_(rows, columns)] = (y @ x.T) / np.where(sizes != 0, sizes, 1)
        asked_at, stored_at = np.repeat(np.arange(b.num_rows), a.num_rows), np.tile(np.arange(a.num_rows), b.num_rows)
        return pa.table({"query_id": b["query_id"].take(pa.array(asked_at)), key: a[key].take(pa.array(stored_at)), "similarity": pa.array(scores.ravel(), mask=~known.ravel())})

    kinds = dict(items.dtypes) | dict(queries.dtypes)
    met = left.groupBy("item_block", "query_block").cogroup(right.groupBy("_item_block", "_query_block"))
    return met.applyInArrow(product, f"query_id {kinds['query_id']}, {key} {kinds[key]}, similarity double")


def classes(items: DataFrame, key: str = "key") -> DataFrame:
    """user_id, ``key``, rep: items of a user with one and the same vector are a class; rep is its least key. Vectors without a length stand alone."""
    least = items.groupBy(F.col("user_id").alias("_user"), F.col("embedding").alias("_vector")).agg(F.min(key).alias("rep"))
    met = items.select("user_id", key, "embedding").join(least, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("embedding").eqNullSafe(F.col("_vector")))
    alone = ~F.coalesce(norm(F.col("embedding")) > 0, F.lit(False))
    return met.select("user_id", key, F.when(alone, F.col(key)).otherwise(F.col("rep")).alias("rep"))


def _cells(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """``rows`` (group, key, unit) with the number ``own`` of their block, and their angles to the group's pivots (null in groups of one block).

    Pivots are the PIVOTS vectors of a group with the least hashes. A vector belongs to the cell of its nearest pivot and of its angle to it, in steps;
    cells of more than a block are split by hashes."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"))
    sized = rows.join(counts, group)
    small = sized.filter(F.col("n") <= BLOCK).select(*group, key, "unit", F.lit(0).cast("long").alias("own"), F.lit(None).cast("array<double>").alias("angles"))
    large = sized.filter(F.col("n") > BLOCK).select(*group, key, "unit")
    first = large.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(key), key))).filter(F.col("_r") <= PIVOTS)
    pivots = first.groupBy(*group).agg(F.flatten(F.collect_list("unit")).alias("pivots"))

    def angles(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                b = batch.slice(start, 1024)
                x = _matrix(pa.chunked_array([b.column("unit")]))
                p = _matrix(pa.chunked_array([b.column("pivots")])).reshape(len(x), -1, x.shape[1])
                made = np.arccos(np.clip(np.einsum("rpd,rd->rp", p, x), -1, 1))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*group, key, "unit")), pa.array(list(made), pa.list_(pa.float64()))], [*group, key, "unit", "angles"])

    kinds = dict(rows.dtypes)
    # One length of vectors at a time in a batch. Pivots are PIVOTS of more than BLOCK vectors of a group, few enough to go to all, and vectors stay where they are.
    dealt = large.sortWithinPartitions("dims").join(F.broadcast(pivots), group)
    made = dealt.mapInArrow(_by_dims(angles), ", ".join(f"{c} {kinds[c]}" for c in (*group, key, "unit")) + ", angles array<double>")
    near = F.array_min("angles")
    cell = (F.array_position("angles", near) * 64 + F.floor(near / STEP)).alias("cell")
    placed = made.select("*", cell)
    sizes = placed.groupBy(*group, "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    own = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64(key), "parts")
    return small.unionByName(placed.join(sizes, [*group, "cell"]).select(*group, key, "unit", own.alias("own"), "angles"))


def _by_dims(run):
    """``run`` over batches of rows with one value of dims each."""

    def split(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            yield from run(batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)

    return split


def block_pairs(cells: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """group, low, high, near: the pairs of blocks of a group (``_cells``), and whether they may hold vectors at or over the threshold: by the triangle inequality they
    can't where for any pivot the angles of one block end farther below those of the other begin than the threshold's angle."""
    ends = [f(F.get("angles", F.lit(i))).alias(f"{n}{i}") for i in range(PIVOTS) for n, f in (("least", F.min), ("most", F.max))]
    blocks = cells.groupBy(*group, "own").agg(*ends)
    other = blocks.select(*(F.col(c).alias(f"_{c}") for c in blocks.columns))
    met = blocks.join(other, [F.col(c) == F.col(f"_{c}") for c in group] + [F.col("own") <= F.col("_own")])
    reach = float(np.arccos(threshold)) + 1e-6
    apart = [(F.col(f"least{i}") - F.col(f"_most{i}") > reach) | (F.col(f"_least{i}") - F.col(f"most{i}") > reach) for i in range(PIVOTS)]
    far = F.coalesce(reduce(lambda x, y: x | y, apart), F.lit(False))
    return met.select(*group, F.col("own").alias("low"), F.col("_own").alias("high"), (~far).alias("near"))


def wide_pairs(cells: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """group, low, high, wide_low, wide_high: the pairs of blocks that may hold vectors at or over the threshold (``block_pairs``), and the wide blocks that they lie in.
    A group's blocks in order make wide blocks of PAIRED bytes, or of one block if that has more."""
    blocks = cells.groupBy(*group, "own").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("own").rowsBetween(Window.unboundedPreceding, -1))
    wide = F.floor(F.coalesce(before, F.lit(0)) * F.col("dims") * 8 / PAIRED)
    placed = blocks.select(*group, "own", wide.alias("wide"))
    pairs = block_pairs(cells, group, threshold).filter("near").drop("near")
    for end in ("low", "high"):
        pairs = pairs.join(placed.withColumnsRenamed({"own": end, "wide": f"wide_{end}"}), [*group, end])
    return pairs


def similar_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """user_id, a, b, similarity: the pairs of one user's distinct vectors (by their least keys, a below b) at or over the threshold.
    ``classes`` has the items that share a vector. Only blocks that may hold such pairs (``block_pairs``) are multiplied.

    A task has a pair of wide blocks, so that a vector travels once for each wide block that it has to meet, however many blocks that holds. It multiplies
    the blocks' pairs by and by and gives their rows away as they come."""
    reps = items.groupBy("user_id", "embedding").agg(F.min("key").alias("key"))
    group = ["dims", "user_id"]
    units = checkpointed(_unit(reps, "embedding").drop("embedding"))
    cells = checkpointed(_cells(units, group, "key"))
    pairs = checkpointed(wide_pairs(cells, group, threshold))
    at = [*group, "wide_low", "wide_high"]
    ends = pairs.select(*at, F.explode(F.array("low", "high")).alias("own")).distinct()
    dealt = cells.drop("angles").join(ends, [*group, "own"]).withColumn("highs", F.lit(None).cast("array<long>"))
    highs = pairs.groupBy(*at, F.col("low").alias("own")).agg(F.sort_array(F.collect_list("high")).alias("highs"))
    dealt = dealt.unionByName(highs, allowMissingColumns=True)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        lists = t.filter(pc.is_valid(t["highs"])).select(["own", "highs"]).to_pylist()
        rows = t.filter(pc.is_null(t["highs"])).sort_by("own")
        del t
        own, units = rows["own"].to_numpy(), _matrix(rows["unit"])
        keys, user = rows["key"].combine_chunks(), rows["user_id"].combine_chunks()
        del rows
        place = lambda block: (int(np.searchsorted(own, block)), int(np.searchsorted(own, block, "right")))
        for x in lists:
            runs = []
            for since, until in map(place, x["highs"]):
                if runs and runs[-1][1] == since:
                    since = runs.pop()[0]
                runs.append((since, until))
            first, last = place(x["own"])
            for since, until in runs:
                step = max(1, SCORES // (until - since))
                for start in range(first, last, step):
                    scores = units[start : min(start + step, last)] @ units[since:until].T
                    i, j = np.nonzero(scores >= threshold)
                    similarity, i, j = scores[i, j], i + start, j + since
                    a, b = keys.take(pa.array(i)), keys.take(pa.array(j))
                    above = pc.greater(a, b)
                    out = pa.RecordBatch.from_arrays([user.take(pa.array(i)), pc.if_else(above, b, a), pc.if_else(above, a, b), pa.array(similarity)], ["user_id", "a", "b", "similarity"])
                    # Within one block each pair is met from either side.
                    yield out.filter(pc.or_(pc.less(a, b), pa.array(own[i] != own[j])))

    close.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    kinds = dict(items.dtypes)
    return dealt.groupBy(*at).applyInArrow(close, f"user_id {kinds['user_id']}, a {kinds['key']}, b {kinds['key']}, similarity double")
