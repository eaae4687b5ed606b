"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2 bits have a common neighbour at distance 1 or less from
both. So every distinct fingerprint emits the 65 values within half the radius; values that two
fingerprints share are their meeting points. A meeting point has 65 possible owners at most,
however many documents there are, and all its owners are within the radius of each other; linking
them to the least of them loses no link. Connected components over distinct fingerprints then give
each document the smallest doc_id that it can reach.

Defined results: texts without words (null ones too) have fingerprint zero, linked like any other; a null
doc_id is never a component's id unless all of the component's are null; repeated rows give a
row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import checkpointed, likely_in, slices
from corpuslake.llm.components import components

SEED = 42
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 16
#: For copies with edits: a text's bands, and the least hashes in a band's key. Two texts at a similarity of 0.8 share no key
#: with probability (1 - 0.8^5)^31, five in a million; at 0.85 it is four in a thousand million.
BANDS, ROWS = 31, 5
#: Texts, and shingles of theirs, that a task compares with each other at a time.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 4_000_000
_MULTIPLY = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit number."""
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        counts += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=max(1, len(words) - shingle + 1))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 where over half of the shingles' XXH64 hashes have it. Signed, as Spark's long."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    return _majority(_hashes(words, shingle)) if words else 0


def shingle_hashes(text: str | None) -> np.ndarray:
    """The hashes of the five-word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    return _hashes(words, 5) if words else np.empty(0, dtype="<u8")


def band_keys(x: np.ndarray) -> list[int]:
    """A key for each band: the least of the set's hashes under ROWS orders. Sets of similarity s share a
    band's key with probability s to the power ROWS."""
    if not len(x):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(x), 1024):
        np.minimum(least, ((x[None, i : i + 1024] ^ _FLIP) * _MULTIPLY).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, rk (hash of the text), fp: a narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array(fps, pa.int64())], ["doc_id", "rk", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), "text").mapInArrow(run, "doc_id long, rk long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v), u above v, that connect all of the distinct fingerprints ``fp`` within 2 bits of each other:
    a meeting point's owners, 65 at most, are linked to the least of them."""
    ball = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    met = distinct.select("fp", F.explode(ball).alias("variant")).groupBy("variant").agg(F.collect_list("fp").alias("owners"))
    several = met.filter(F.size("owners") > 1).withColumn("v", F.array_min("owners"))
    pairs = several.select(F.explode("owners").alias("u"), "v").filter("u <> v").distinct()
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)


def _named(marked: DataFrame) -> DataFrame:
    """fp, component_id, keeper: each distinct fingerprint with the first document (doc_id, then rk) of its component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk"))
    distinct = checkpointed(marked.groupBy("fp").agg(first.alias("first")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.rk").alias("keeper"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: a row for each document."""
    marked = checkpointed(fingerprints(docs, shingle))
    return marked.join(_named(marked), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Two sets of n and m shingles have a similarity of 0.8 or more where 9 * common >= 4 * (n + m).
def _alike(common: F.Column, n: F.Column, m: F.Column) -> F.Column:
    return 9 * common >= 4 * (n + m)


def _bare() -> F.Column:
    """Texts without words are all alike, whatever white space they have."""
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]+$", "")


def _marks(docs: DataFrame) -> DataFrame:
    """doc_id, rk, fp (of five-word shingles) and band keys of each document: a narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_hashes(t) for t in batch.column("text").to_pylist()]
            fps = pa.array([_majority(x) if len(x) else 0 for x in hashes], pa.int64())
            keys = pa.array([band_keys(np.unique(x)) for x in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), fps, keys], ["doc_id", "rk", "fp", "keys"])

    return docs.mapInArrow(run, "doc_id long, rk long, fp long, keys array<long>")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """rk, n, shingles: all of the distinct hashes of each text of ``texts`` (rk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            sets = [np.unique(shingle_hashes(t)).view("<i8") for t in batch.column("text").to_pylist()]
            made = [pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("rk"), *made], ["rk", "n", "shingles"])

    return texts.mapInArrow(run, "rk long, n long, shingles array<long>")


def _ball_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (u, v) of texts (rk, fp) that connect all whose fingerprints differ in 2 bits at most."""
    heads = checkpointed(texts.groupBy("fp").agg(F.min("rk").alias("head"), F.max("rk").alias("last")))
    same = texts.join(heads.filter("head < last"), "fp").select(F.col("rk").alias("u"), F.col("head").alias("v"))
    of = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    near = links(heads.select("fp")).join(of("u"), "u").join(of("v"), "v").select("u_head", "v_head")
    return same.filter("u <> v").union(near)


def _rare_first(sets: DataFrame) -> DataFrame:
    """h, f, rk, n, q: of each set, ordered from the rarest of all hashes to the commonest, those of the first n/5 + 1 that
    another set has too, with how many sets have them (f) and their place q.

    Two sets at a similarity of 0.8 or more share a hash there, for either has at least 0.8 n hashes of the other's; and where the
    first that they share stands at q, no more than n - q are shared. A line that a great many texts share comes last in
    each, and so brings none of them together."""
    tokens = sets.select("rk", F.explode("shingles").alias("h"))
    counts = tokens.groupBy("h").agg(F.count("*").alias("f")).filter("f > 1")
    shared = tokens.join(counts, "h").groupBy("rk").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("shared")).join(sets.select("rk", "n"), "rk")
    alone = F.col("n") - F.size("shared")
    room = F.greatest(F.lit(0), F.floor(F.col("n") / 5) + 1 - alone).cast("int")
    first = shared.select("rk", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), room)).alias("at", "token"))
    return first.select("token.h", "token.f", "rk", "n", (F.col("alone") + F.col("at")).alias("q"))


def _may(a: str, b: str) -> F.Column:
    """Whether sizes and places leave room for a similarity of 0.8 between two owners of a hash (structs with n, q)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    return near & _alike(n - F.col(f"{a}.q"), n, m) & _alike(m - F.col(f"{b}.q"), n, m)


def _pairs(met: DataFrame) -> DataFrame:
    """Each pair of the owners a and b once."""
    u, v = F.greatest("a.rk", "b.rk").alias("u"), F.least("a.rk", "b.rk").alias("v")
    return met.filter((F.col("a.rk") != F.col("b.rk")) & _may("a", "b")).select(u, v).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose whole sets have a similarity of 0.8 or more."""
    of = lambda end: sets.select(F.col("rk").alias(end), F.col("n").alias(f"{end}_n"), F.col("shingles").alias(f"{end}_set"))
    met = pairs.join(of("u"), "u").join(of("v"), "v")
    common = F.size(F.array_intersect("u_set", "v_set"))
    return checkpointed(met.filter(_alike(common, F.col("u_n"), F.col("v_n"))).select("u", "v"))


def _atoms(rooted: DataFrame) -> DataFrame:
    """h, x, y, block, rk, of: the owners of the hashes whose owners (h, f, rk, n, of, head: their group and the first owner's) are in several
    groups, in blocks of which x and y are to be compared.

    Hashes with the same owners, as those of a passage, are one: that which comes first in the order of all. Of blocks there are as many as
    BLOCK_TEXTS and BLOCK_SHINGLES ask for, so that an owner is one row as long as these hold all owners, and one more for each further block."""
    mark = lambda seed: F.bit_xor(F.xxhash64("rk", F.lit(seed)))
    each = rooted.groupBy("h", "f").agg(F.max(F.col("of") != F.col("head")).alias("several"), F.count("*").alias("owners"), F.sum("n").alias("shingles"), mark(0).alias("mark"), mark(1).alias("other_mark"))
    first = each.filter("several").groupBy("owners", "shingles", "mark", "other_mark").agg(F.min(F.struct("f", "h")).alias("first"))
    blocks = F.greatest(F.ceil(F.col("owners") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    dealt = rooted.select("h", "rk", "of").join(first.select("first.h", blocks.alias("blocks")), "h").withColumn("block", F.pmod(F.xxhash64("rk"), "blocks"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select("h", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "rk", "of")


def _links_between(table: pa.Table) -> pa.Table:
    """(u, v): links of two texts of different groups that join all groups that any such link joins, from the rows of one (h, x, y) with their sets."""
    rk, block = (table.column(c).to_numpy() for c in ("rk", "block"))
    _, group = np.unique(table.column("of").to_numpy(), return_inverse=True)
    sets = table.column("shingles").combine_chunks()
    starts = sets.offsets.to_numpy().astype(np.int64)
    n, starts = np.diff(starts), starts[:-1] - starts[0]
    known, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    apart = len(table) > 1 and table.column("x")[0].as_py() != table.column("y")[0].as_py()
    made: list[tuple[int, int]] = []
    most = np.bincount(group).argmax()
    present = np.zeros(len(known), dtype=np.int64)
    for i in np.flatnonzero(group != most):  # texts of the largest group need no other's comparison
        open_ = (group != group[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
        if apart:
            open_ &= block != block[i]
        if not open_.any():
            continue
        own = flat[starts[i] : starts[i] + n[i]]
        present[own] = 1
        common = np.add.reduceat(present[flat], starts)
        present[own] = 0
        for j in np.flatnonzero(open_ & (9 * common >= 4 * (n + n[i]))):
            if group[j] != group[i]:
                made.append((max(rk[i], rk[j]), min(rk[i], rk[j])))
                group[group == group[j]] = group[i]
    u, v = zip(*made) if made else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def edited_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marked, texts, roots) for near copies: texts that a chain of links joins, each link between two texts whose sets of
    five-word shingles have a similarity of 0.8 or more.

    marked has doc_id, rk of each document; texts has rk, first (no doc_id, doc_id), copies of each distinct text; roots has node, root of
    each text that isn't the least of its group.

    Ball hashing finds the links of fingerprints within 2 bits. A few edits move a long fingerprint further, so that the other
    links need more: texts that share one of their band keys with another are joined on their rarest shingles. Of the
    owners of such a shingle each is compared with the one that has it earliest. Where that leaves them in several
    groups, as the fillings of a form, blocks of owners meet in tasks that compare whole sets and return no more than a link for each two groups that
    they join: neither step has a row for each pair. Every link is verified on whole sets.

    A text without words is no near copy of any but those without words too; null and empty texts are alike, ties and
    repeated rows make no difference; an empty table gives empty tables; extra columns are ignored."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_bare()).alias("rk"), "text")
    marked = checkpointed(_marks(read))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    texts = checkpointed(marked.groupBy("rk").agg(first, F.count("*").alias("copies"), F.min("fp").alias("fp")))
    ball = checkpointed(_ball_pairs(texts))
    owned = marked.select(F.explode("keys").alias("key"), "rk")
    several = owned.groupBy("key").agg(F.min("rk").alias("low"), F.max("rk").alias("high")).filter("low < high")
    met = owned.join(several, "key", "left_semi").select("rk").union(ball.select("u")).union(ball.select("v"))
    met = checkpointed(met.distinct())
    asked = likely_in(read, "rk", met).groupBy("rk").agg(F.first("text").alias("text")).join(met, "rk", "left_semi")
    sets = checkpointed(_shingle_sets(asked))

    owners = checkpointed(_rare_first(sets))
    one = F.struct("q", "n", "rk")
    heads = owners.groupBy("h").agg(F.min(one).alias("b"), F.max("rk").alias("high"), F.min("rk").alias("low")).filter("low < high")
    near = checkpointed(owners.select("h", "f", one.alias("a")).join(heads.select("h", "b"), "h"))
    real = _similar(_pairs(near).union(ball).distinct(), sets)
    groups = components(real)
    late = _late_links(near, groups, sets)
    if not late.isEmpty():
        groups = components(real.union(late))
    return marked.select("doc_id", "rk"), texts.select("rk", "first", "copies"), groups


def _late_links(near: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links between texts of different groups, from the owners of each hash and its first one (near) and the groups so far (node, root)."""
    root = lambda end: groups.select(F.col("node").alias(f"{end}_rk"), F.col("root").alias(f"{end}_root"))
    rooted = near.withColumn("a_rk", F.col("a.rk")).withColumn("b_rk", F.col("b.rk")).join(root("a"), "a_rk", "left").join(root("b"), "b_rk", "left")
    rooted = checkpointed(rooted.select("h", "f", F.col("a.rk").alias("rk"), F.col("a.n").alias("n"), F.coalesce("a_root", "a_rk").alias("of"), F.coalesce("b_root", "b_rk").alias("head")))
    met = _atoms(rooted).join(sets.select("rk", "shingles"), "rk")
    return checkpointed(met.groupBy("h", "x", "y").applyInArrow(_links_between, "u long, v long").distinct())


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the first document, by doc_id, of each group of near copies (``edited_copies``).

    Rows without doc_id come last, and of equal doc_ids one with the least hash of its text stays; of wholly repeated rows one
    stays. Null and empty texts are one group; an empty table stays empty; all columns are kept, whatever their names."""
    marked, texts, roots = edited_copies(docs)
    rooted = texts.join(roots.withColumnRenamed("node", "rk"), "rk", "left").select("rk", "first", F.coalesce("root", "rk").alias("root"))
    head = rooted.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id", "rk")).alias("head"))
    copies = marked.groupBy("doc_id", "rk").agg(F.count("*").alias("copies"))
    kept = head.select(F.col("head.doc_id").alias("component_id"), F.col("head.rk").alias("keeper"))
    kept = kept.join(copies, F.col("component_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper") == F.col("rk"))).select("component_id", "keeper", "copies")
    # Documents whose text is alone stay without a shuffle.
    grouped = texts.filter("copies > 1").select("rk").union(roots.select("node")).union(roots.select("root")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_bare()).alias("rk"))
    grouped = checkpointed(grouped)
    sure, asked = likely_in(rows, "rk", grouped, False), likely_in(rows, "rk", grouped)
    stay = asked.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("rk") == F.col("keeper")))
    repeated = stay.filter("copies > 1").dropDuplicates(["doc_id", "rk"])
    return sure.select("row.*").unionByName(stay.filter("copies = 1").select("row.*")).unionByName(repeated.select("row.*"))
