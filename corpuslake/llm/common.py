"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.sources.scratch import checkpointed, fresh, remove, shared_dir

__all__ = ["ascii_lower", "checkpointed", "fresh", "likely_in", "remove", "row_key", "shared_dir", "slices", "staged", "table", "words"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; ``lower`` would change other letters too."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, an executor's
    loss costs nothing that is already written, and values drawn from task numbers become fixed. The files go when the driver ends."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the filter of ``likely_in``, in maps of 4 KB: 4 MB in all, however many keys there are.
FILTER_BITS, MAP_BITS = 1 << 25, 1 << 15


def likely_in(df: DataFrame, key: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a hash) may be in the first column of ``wanted``, or with ``inside`` false those whose key surely
    isn't. Both together are all rows of ``df``. The filter is 4 MB at most; where ``wanted`` fills it, every row may be in."""
    spot = lambda c: F.pmod(c, F.lit(FILTER_BITS))
    bits = wanted.select(spot(F.col(wanted.columns[0])).alias("p")).distinct().select((F.col("p") % MAP_BITS).alias("bit"), F.floor(F.col("p") / MAP_BITS).alias("_map"))
    maps = bits.repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    at = spot(F.col(key)) % MAP_BITS
    byte = F.conv(F.hex(F.substring(F.coalesce("_bits", F.lit(b"")), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = df.withColumn("_map", F.floor(spot(F.col(key)) / MAP_BITS)).join(F.broadcast(maps), "_map", "left")
    return marked.filter(hit if inside else ~hit).drop("_map", "_bits")


def row_key(df: DataFrame, text: str = "text") -> Column:
    """Second half of a document's identity beside doc_id: rows that share both are copies of each
    other in everything that the operators read."""
    return F.xxhash64(F.col(text))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that only a few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
