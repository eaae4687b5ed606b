"""Packing of documents into fixed-length training sequences: concatenate and cut.

Pass one tokenises every document once, inside its input partition, and stages the ids with the
partition's number and the running token count in front of each document. The totals of the
partitions (one row each) are prefix-summed into global offsets. Pass two adds a document's offset and
cuts its ids wherever a window of ``length`` tokens ends; a document that crosses the end gives a
boundary record on either side. Ids are never shuffled.

Defined results: a null text counts as empty and gives the end id alone; repeated rows are documents of
their own; a null doc_id stays null; an empty table gives no rows; extra columns are ignored. Texts of
any length are tokenised whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import slices, staged

#: The pre-tokenising pattern that belongs to the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 400_000


class _Unsafe(Exception):
    """The text has white space beside a space, where pieces can't be encoded on their own."""


class PieceCache(dict):
    """Ids, as little-endian 32-bit bytes, of `` piece``. A space between two characters that aren't
    white space always starts a new token, so texts split there encode piece by piece."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unsafe
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = np.asarray(self.encode(" " + piece), dtype="<u4").tobytes()
        return ids


class Tokens:
    """Texts to ids of a byte-level BPE vocabulary given as a rank file."""

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {k: v for k, v in SPECIAL.items() if v not in ranks.values()}
        self.bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)
        self.cache = PieceCache(self.bpe.encode_ordinary)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.asarray(self.bpe.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Unsafe
            head = np.asarray(self.bpe.encode_ordinary(first), dtype="<u4").tobytes()
            return head + b"".join(map(self.cache.__getitem__, rest))
        except _Unsafe:
            return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()


_TOKENS: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def tokenised(docs: DataFrame, ranks_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, part, before (tokens of the partition in front of the document), n, ids (16-bit if all
    fit, else 32-bit), staged in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, before, end = _tokens(ranks_path), TaskContext.get().partitionId(), 0, np.uint32(end_id).tobytes()
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(tokens(text) + end, dtype="<u4")
                wide = int(ids.max()) > 0xFFFF
                out.append((doc, part, before, len(ids), wide, ids.tobytes() if wide else ids.astype("<u2").tobytes()))
                before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()])], ["doc_id", "part", "before", "n", "wide", "ids"])

    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, part int, before long, n long, wide boolean, ids binary"), "tokens")


def pack(docs: DataFrame, ranks_path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenised(docs, ranks_path, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per input partition, however many documents there are; so the window and the broadcast are small.
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("before")).alias("first"), "n", "wide", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, first, n, wide, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = raw if wide else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(length - offset, n - start)
                    out.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, sequence, offset))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
