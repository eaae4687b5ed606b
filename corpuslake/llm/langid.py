"""Language identification by nearest centroid over hashed TF-IDF character n-grams.

Texts become counts of their 1- to 3-grams of lower-cased letters, words apart, hashed to ``DIMS`` buckets;
counts are damped, weighed by inverse document frequency and normalised. Document frequencies cover all
labelled rows. Each language's centroids come from spherical k-means over a bounded sample of
its distinct labelled texts (``per_language`` at most, by the least hashes). A text goes to the language of the centroid
with the largest cosine; it is rejected where that is far below what the centroid's own members have.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if nothing is
labelled; null labels aren't learned from; repeated rows are judged alike; an empty table gives no rows; extra
columns are ignored. Texts of any length count whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import slices

DIMS = 4096
#: Most distinct texts of each language that centroids are fitted on.
PER_LANGUAGE = 250
CENTROIDS = 8
ROUNDS = 12
#: More labels than this are refused: the model is held by every task.
MOST_LANGUAGES = 500
#: Rejected: below this part of the similarity that 99 of 100 members of the centroid exceed; in proportion less for texts of fewer than FULL letters.
SLACK, FULL = 0.5, 300
BLOCK = 1 << 18
NONE = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts by bucket, and the number of letters."""
    counts, letters, table = np.zeros(DIMS, dtype=np.int64), 0, _letters()
    low = (text or "").lower()
    # The last two characters, white space and the like as one 32, go on to the next block; a text begins and ends with one.
    tail = np.empty(0, dtype=np.uint32)
    for start in range(0, len(low) or 1, BLOCK):
        x = np.frombuffer(low[start : start + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        known = table[x]
        letters += int(known.sum())
        x = np.where(known, x, np.uint32(32)).astype(np.uint32)
        x = np.concatenate([tail if start else np.array([32], dtype=np.uint32), x, np.full(int(start + BLOCK >= len(low)), 32, dtype=np.uint32)])
        space = x == 32
        x = x[np.append(True, ~(space[1:] & space[:-1]))]
        old = len(tail)
        a = x * np.uint32(0x9E3779B1)
        two = a[:-1] * np.uint32(5) + x[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
        three = two[:-1] * np.uint32(7) + x[2:] * np.uint32(0xC2B2AE3D) + np.uint32(2)
        grams = np.concatenate([a[old:], two[max(0, old - 1) :], three[max(0, old - 2) :]])
        grams ^= grams >> np.uint32(15)
        grams *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(grams >> np.uint32(20), minlength=DIMS)
        tail = x[-2:]
    return counts, letters


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray


def document_frequencies(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of ``labelled``; what reaches the driver is a number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(DIMS, dtype=np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0):
                found += gram_counts(text.as_py())[0] > 0
                rows += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMS), pa.int32()), pa.array(np.append(rows, found))], ["bucket", "docs"])

    sums = labelled.select("text").mapInArrow(run, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()
    got = {r.bucket: r.docs for r in sums}
    return np.array([got.get(i, 0) for i in range(DIMS)]), got.get(-1, 0)


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from rows far from each other; centroids and the similarity of their near members."""
    centres = [x.mean(0) / max(np.linalg.norm(x.mean(0)), 1e-12)]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(1).argmin()])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for i in range(len(c)):
            if (own == i).any():
                m = x[own == i].mean(0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    best = x @ c.T
    own = best.argmax(1)
    near = [best[own == i, i] if (own == i).any() else best.max(1) for i in range(len(c))]
    return c, np.array([np.quantile(members, 0.01) for members in near])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model | None:
    """From rows with text and lang (any label string); None if there are none."""
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    seen, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + seen)) + 1
    # So many distinct texts of each language at most, by the least hashes; copies count once, and any language has one.
    marked = labelled.withColumn("h", F.xxhash64("text"))
    # First the least of each of 64 parts of a language, which may have a great many texts; then the least of these.
    least = marked.select("lang", "h", F.pmod("h", F.lit(64)).alias("part")).distinct()
    for keys in (["lang", "part"], ["lang"]):
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        least = least.withColumn("n", order).filter(F.col("n") <= per_language).drop("n")
    least = least.select("lang", "h")
    chosen = marked.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(np.array([gram_counts(t)[0] for t in sorted(pdf.text)]), idf)
        c, radius = _clusters(x, centroids)
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "centroid": [row.astype("<f4").tobytes() for row in c], "radius": radius})

    rows = chosen.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, radius double").collect()  # a few rows a language
    rows.sort(key=lambda r: (r.lang, r.centroid))
    if not rows:
        return None
    return Model([r.lang for r in rows], np.array([np.frombuffer(r.centroid, "<f4") for r in rows]), np.array([r.radius for r in rows]), idf)


def _judged(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    """First column as it is, lang_pred, score, rejected, of batches with a column ``text``."""
    for batch in slices(batches):
        found = [gram_counts(t) for t in batch.column("text").to_pylist()]
        letters = np.array([x[1] for x in found])
        if model is None:
            lang, score, out = [NONE] * len(found), np.zeros(len(found)), np.ones(len(found), dtype=bool)
        else:
            sims = _vectors(np.array([x[0] for x in found]), model.idf) @ model.centroids.T
            best = sims.argmax(1)
            score = np.clip(sims.max(1).astype(np.float64), 0, 1) * (letters > 0)
            out = (score < SLACK * model.radius[best] * np.minimum(1, letters / FULL)) | (letters == 0)
            lang = [model.languages[b] if n else NONE for b, n in zip(best, letters)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], [batch.schema.names[0], "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """``key``, lang_pred, score (cosine with the nearest centroid, 0 to 1), rejected."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(lambda batches: _judged(batches, model), f"`{key}` {kind}, lang_pred string, score double, rejected boolean")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from the rows that aren't held out."""
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()), per_language)
    return predict(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` without the rejected rows; a null lang becomes the predicted one. Where no row has a lang to learn from all stay. Rows pass as Arrow columns, and
    only a few texts at a time are Python objects."""
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()), per_language)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            judged = next(_judged([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column("text")], ["row", "text"])], model))
            at = batch.schema.get_field_index("lang")
            filled = pc.coalesce(batch.column(at), judged.column("lang_pred").cast(batch.column(at).type))
            yield batch.set_column(at, batch.schema.field(at).name, filled).filter(pc.invert(judged.column("rejected")))

    return docs.mapInArrow(run, docs.schema)
