"""Prefix trie of conversations by the Euler-tour technique.

Turns are numbered through sorted ranges, and a prefix is known by two running 64-bit sums over hashes of (place, role and text): each range adds up its own turns, and
what lies before comes from the ranges before, so that a conversation of any length meets in no task. A node is a distinct prefix, named by its depth and
its smallest member.

Every node has an enter and an exit arc. An enter arc is followed by that of the first child, or by the node's own exit; an exit arc by the enter arc of the next sibling, or
by the parent's exit. The tour is list-ranked: tasks hold ranges of nodes in the order of members, where most arcs follow one another, and contract the stretches
of the tour that they hold; the chains that are left are ranked in one task while there are LOCAL of them at most, and by pointer jumping over joins
beyond. Prefix sums at a node's two arcs then differ by what its subtree holds.

Defined results: rows without conv_id belong to no conversation; a null role or text is empty; a null turn comes first; turns with the same number come in
the order of their content's MD5; repeated rows are turns of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpuslake.llm.common import checkpointed, staged
from corpuslake.llm.ranges import previous, ranged, running

#: Nodes that a task contracts, and chains that one task ranks.
LOCAL = 1 << 19
#: Ids that are joined to a piece of text before they are hashed.
CHUNK = 8192
_WEIGHTS = ("rank", "leaves", "saved")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest (MD5 of role and text), size (code points of the text) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit("/"), role, text), "utf-8")))
    # Rows alike go to several ranges: any order of them is the same.
    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    turns = read.filter("conv_id IS NOT NULL").withColumn("one", F.lit(1).cast("long"))
    placed = running(ranged(turns, "conv_id", F.col("turn").asc_nulls_first(), "digest", "salt"), "conv_id", ["one"])
    return placed.select("conv_id", F.col("one_sum").alias("place"), "digest", "size")


def spliced(turns: DataFrame, head: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, bare): of each conversation c the first h = crc32(c) % head turns of the first conversation of its family, c - c % family, then c's own after
    its first h; as ``numbered`` with last (whether it is the conversation's last turn), and the conv_ids of those left without turns."""
    turns = staged(turns, "turns")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    first = F.col("conv_id") - F.col("conv_id") % family
    leads = lengths.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("lead"), F.least("n", F.lit(head)).alias("lead_n"))
    convs = lengths.select("conv_id", "n", h.alias("h"), first.alias("lead")).join(leads, "lead", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("lead_n", F.lit(0).cast("long"))))
    convs = staged(convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h"))), "lengths")
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("place") < head)).withColumnRenamed("conv_id", "lead")
    ahead = heads.join(convs.filter("taken > 0").select("lead", "conv_id", "taken", "length"), "lead").filter("place <= taken")
    own = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    made = [x.select("conv_id", "place", "digest", "size", (F.col("place") == F.col("length")).alias("last")) for x in (ahead, own)]
    return made[0].union(made[1]), convs.filter("length = 0").select("conv_id")


def prefixes(turns: DataFrame, bare: DataFrame) -> DataFrame:
    """conv_id, depth, size, last, a, b (the prefix), pa, pb (the one before): a row for each turn, and one of depth 0 for each conversation."""
    lanes = {"a": F.xxhash64("digest", "place"), "b": F.xxhash64("place", "digest", F.lit(1))}
    keyed = running(ranged(turns.withColumns(lanes), "conv_id", "place"), "conv_id", ["a", "b"])
    rows = keyed.select("conv_id", F.col("place").alias("depth"), "size", "last", F.col("a_sum").alias("a"), F.col("b_sum").alias("b"), F.col("a_before").alias("pa"), F.col("b_before").alias("pb"))
    rows = staged(rows, "prefixes")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = rows.filter("depth = 1").select("conv_id", F.lit(False).alias("last")).union(bare.select("conv_id", F.lit(True)))
    return rows.union(roots.select("conv_id", zero, zero, "last", zero, zero, none, none))


def ends(rows: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the prefixes that conversations end with: the SHA-256 of these conversations' ids, ascending and joined by commas.

    Ids are joined to pieces in sorted ranges, and a prefix's pieces are hashed one after the other: what a task holds is a piece."""
    key = ["depth", "a", "b"]
    sorted_ids = ranged(rows.filter("last").select(*key, "conv_id"), *key, "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*made))[:4]), pa.array([m[4] for m in made], pa.string())], [*key, "first", "piece"])

        at, ids = None, []
        for batch in batches:
            made = []
            for *prefix, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id"))):
                if prefix != at or len(ids) == CHUNK:
                    if ids:
                        made.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = prefix, []
                ids.append(conv)
            if made:
                yield out(made)
        if ids:
            yield out([(*at, ids[0], ",".join(map(str, ids)))])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            made = []
            for *prefix, piece in zip(*(batch.column(c).to_pylist() for c in (*key, "piece"))):
                if prefix == at:
                    sha.update(b",")
                else:
                    if sha:
                        made.append((*at, sha.hexdigest()))
                    at, sha = prefix, hashlib.sha256()
                sha.update(piece.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], [*key, "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, sha.hexdigest())], [*key, "ends_sha256"])

    cut = sorted_ids.mapInArrow(pieces, "depth long, a long, b long, first long, piece string")
    return cut.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashes, "depth long, a long, b long, ends_sha256 string")


def _nodes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, size, n_convs, n_children, parent_conv_id, first_child (its conv_id), next_sibling (its conv_id), ends_sha256."""
    most = [F.max(c).alias(c) for c in ("size", "pa", "pb")]  # the same in all of a node's rows
    nodes = staged(rows.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *most), "nodes")
    key = ["depth", "a", "b"]
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    parents = nodes.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    root = nodes.filter("depth = 0").select("conv_id").first()
    top = nodes.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long")))
    deep = nodes.filter("depth > 1").join(parents, ["depth", "pa", "pb"])
    none = hashlib.sha256().hexdigest()
    full = top.unionByName(deep).join(children, key, "left").join(ends(rows), key, "left")
    full = full.select("conv_id", "depth", "size", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "parent_conv_id", "first_child", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    # Siblings in descending order: the row before is the next one of the tour.
    beside = previous(ranged(full, "parent_conv_id", "depth", F.col("conv_id").desc()), ["parent_conv_id", "depth", "conv_id"])
    same = F.col("last_parent_conv_id").eqNullSafe(F.col("parent_conv_id")) & (F.col("last_depth") == F.col("depth"))
    return staged(beside.select(*full.columns, F.when(same, F.col("last_conv_id")).alias("next_sibling")), "siblings")


def _ranked(before: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, sums): for each element the first one of its list, and what all before it add up to. ``before`` has the place of the element before,
    or -1, and ``sums`` what that one adds, or 0."""
    at = np.where(before >= 0, before, np.arange(len(before)))
    while True:  # pointer jumping
        further = at[at]
        if (further == at).all():
            return at, sums
        sums = sums + sums[:, at]
        at = further


_CHAIN = StructType([StructField(c, LongType()) for c in ("chain", "conv", "depth", "kind", "next_conv", "next_depth", "next_kind", *_WEIGHTS)])
_PLACES = [f"{kind}_{x}" for kind in ("enter", "exit") for x in ("chain", *_WEIGHTS)]


def _contracted(nodes: DataFrame, local: int) -> DataFrame:
    """``nodes`` with the chain of each of their arcs and the sums before it there, and, for arcs that begin a chain, the chain itself."""
    spark = nodes.sparkSession
    parts = max(ceil(nodes.count() / local), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranged(nodes, "conv_id", "depth", parts=parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n, part = table.num_rows, table.column("part")[0].as_py()
        column = lambda c: table.column(c).fill_null(0).to_numpy()
        there = lambda c: table.column(c).is_valid().to_numpy(zero_copy_only=False)
        conv, depth = column("conv_id"), column("depth")
        known, start, many = np.unique(conv, return_index=True, return_counts=True)

        def find(c: np.ndarray, d: np.ndarray) -> np.ndarray:
            """The row of a node; -1 where it isn't here. A member's nodes lie one below the other."""
            i = np.minimum(np.searchsorted(known, c), len(known) - 1)
            row = d - depth[start[i]]
            return np.where((known[i] == c) & (row >= 0) & (row < many[i]), start[i] + row, -1)

        leaf, follows, inner = ~there("first_child"), there("next_sibling"), there("parent_conv_id")
        # Arc i enters node i, arc n + i leaves it.
        next_conv = np.concatenate([np.where(leaf, conv, column("first_child")), np.where(follows, column("next_sibling"), column("parent_conv_id"))])
        next_depth = np.concatenate([np.where(leaf, depth, depth + 1), np.where(follows, depth, depth - 1)])
        next_kind = np.concatenate([leaf, ~follows]).astype(np.int64)
        more = np.concatenate([np.ones(n, dtype=bool), follows | inner])
        at = find(next_conv, next_depth)
        here = more & (at >= 0)
        before = np.full(2 * n, -1, dtype=np.int64)
        before[(at + n * next_kind)[here]] = np.flatnonzero(here)
        none = np.zeros(n, dtype=np.int64)
        weights = np.stack([np.ones(2 * n, dtype=np.int64), np.concatenate([leaf, none]), np.concatenate([(column("n_convs") - 1) * column("size"), none])])
        head, sums = _ranked(before, np.where(before >= 0, weights[:, before], 0))
        tail = np.flatnonzero(~here)
        last = np.full(2 * n, -1, dtype=np.int64)
        last[head[tail]] = tail
        begins, ids = last >= 0, (part << 32) + np.arange(2 * n)
        end = np.where(begins, last, 0)
        total = sums[:, end] + weights[:, end]

        def chain(kind: int) -> pa.Array:
            own, e = slice(kind * n, (kind + 1) * n), end[kind * n : (kind + 1) * n]
            nexts = [pa.array(x[e], mask=~more[e]) for x in (next_conv, next_depth, next_kind)]
            fields = [pa.array(ids[own]), pa.array(conv), pa.array(depth), pa.array(np.full(n, kind)), *nexts, *(pa.array(t[own]) for t in total)]
            return pa.StructArray.from_arrays(fields, _CHAIN.names, mask=pa.array(~begins[own]))

        places = [pa.array(x) for kind in (0, 1) for x in (ids[head[kind * n : (kind + 1) * n]], *(s[kind * n : (kind + 1) * n] for s in sums))]
        made = pa.Table.from_arrays([*(c.combine_chunks() for c in table.columns), *places, chain(0), chain(1)], [*table.column_names, *_PLACES, "enter_begins", "exit_begins"])
        yield from made.to_batches(max_chunksize=10_000)

    schema = StructType(list(dealt.schema))
    for c in _PLACES:
        schema = schema.add(c, "long")
    return staged(dealt.mapInArrow(run, schema.add("enter_begins", _CHAIN).add("exit_begins", _CHAIN)).drop("part"), "arcs")


def _chain_sums(arcs: DataFrame, local: int) -> DataFrame:
    """chain, rank, leaves, saved: of each chain what the chains before it in the tour add up to."""
    chains = staged(arcs.select(F.explode(F.array("enter_begins", "exit_begins")).alias("c")).filter("c IS NOT NULL").select("c.*"), "chains")
    to = chains.filter("next_conv IS NOT NULL").select(F.col("chain").alias("before"), F.col("next_conv").alias("conv"), F.col("next_depth").alias("depth"), F.col("next_kind").alias("kind"), *(F.col(w).alias(f"{w}_before") for w in _WEIGHTS))
    zero = F.lit(0).cast("long")
    linked = chains.join(to, ["conv", "depth", "kind"], "left").select("chain", "before", *(F.coalesce(f"{w}_before", zero).alias(w) for w in _WEIGHTS))
    if chains.count() <= local:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                table = pa.Table.from_batches(held)
                order = np.argsort(table.column("chain").to_numpy())
                chain = table.column("chain").to_numpy()[order]
                before = table.column("before").fill_null(-1).to_numpy()[order]
                place = np.where(before >= 0, np.searchsorted(chain, np.maximum(before, 0)), -1)
                _, sums = _ranked(place, np.stack([table.column(w).to_numpy()[order] for w in _WEIGHTS]))
                yield pa.RecordBatch.from_arrays([pa.array(chain), *map(pa.array, sums)], ["chain", *_WEIGHTS])

        return linked.repartition(1).mapInArrow(run, "chain long, rank long, leaves long, saved long")
    now = checkpointed(linked)
    while not now.filter("before IS NOT NULL").isEmpty():
        of = now.select(F.col("chain").alias("before"), F.col("before").alias("further"), *(F.col(w).alias(f"{w}_more") for w in _WEIGHTS))
        now = checkpointed(now.join(of, "before", "left").select("chain", F.col("further").alias("before"), *((F.col(w) + F.coalesce(f"{w}_more", zero)).alias(w) for w in _WEIGHTS)))
    return now.select("chain", *_WEIGHTS)


def prefix_tree(turns: DataFrame, bare: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter, leave (places of the
    node's arcs in the tour): a row for each distinct prefix, from the root (depth 0).

    ``turns`` has conv_id, place, digest, size, last, and ``bare`` the conv_ids of conversations without turns (``spliced``)."""
    arcs = _contracted(_nodes(prefixes(turns, bare)), local)
    sums = staged(_chain_sums(arcs, local), "sums")
    for kind in ("enter", "exit"):
        of = sums.select(F.col("chain").alias(f"{kind}_chain"), *(F.col(w).alias(f"{kind}_{w}_before") for w in _WEIGHTS))
        arcs = arcs.join(of, f"{kind}_chain")
    at = {(kind, w): F.col(f"{kind}_{w}") + F.col(f"{kind}_{w}_before") for kind in ("enter", "exit") for w in _WEIGHTS}
    held = {w: at["exit", w] - at["enter", w] for w in _WEIGHTS}
    return arcs.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", held["leaves"].alias("n_leaves"), held["saved"].alias("saved_tokens"), "ends_sha256", at["enter", "rank"].alias("enter"), at["exit", "rank"].alias("leave"))
