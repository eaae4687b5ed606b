"""Media columns: lossless 8-bit PNG images in binary columns, and low-frequency hashes of them.

``encode`` stores each payload as a grey image 64 samples wide, one filter byte per line, in zlib chunks;
``features`` reads the stored bytes back: signature, chunk order and checksums are tested, lines are
unfiltered with numpy (the two filters that look at the pixel before, which ``encode`` never uses, pixel by pixel), and the cosine transform of the image, averaged down to 32 by 32, gives a 64-bit
hash of its 8 by 8 lowest frequencies. Both are narrow maps: nothing is shuffled.

Defined results: a null or empty text gives one line of 64 zero samples; equal texts give equal values; a
null doc_id stays null; an empty table gives no rows; extra columns are ignored. A damaged image raises
``ValueError`` in ``decode_png``; nothing is guessed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import slices

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Compressed bytes in one IDAT chunk.
CHUNK = 1 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray) -> bytes:
    """A grey 8-bit image; every line takes filter 0, or 2 (difference to the line above) where that
    gives smaller absolute differences."""
    height, width = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    size = lambda x: np.abs(x.view(np.int8).astype(np.int16)).sum(1)
    use = size(up) < size(samples)
    lines = np.empty((height, width + 1), dtype=np.uint8)
    lines[:, 0] = np.where(use, 2, 0)
    lines[:, 1:] = np.where(use[:, None], up, samples)
    packed = zlib.compress(lines.tobytes(), 6)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """All five line filters, for one byte a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown line filter")
    y, height = 0, len(out)
    while y < height:
        kind, above = kinds[y], out[y - 1] if y else np.zeros(out.shape[1], dtype=np.uint8)
        if kind == 0:
            y += 1
        elif kind == 1:
            out[y] = np.cumsum(out[y], dtype=np.uint8)
            y += 1
        elif kind == 2:
            end = y + 1
            while end < height and kinds[end] == 2:
                end += 1
            out[y] += above
            np.cumsum(out[y:end], axis=0, dtype=np.uint8, out=out[y:end])
            y = end
        else:
            line, left, corner = out[y], 0, 0
            for x in range(len(line)):
                b = int(above[x])
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    near = (abs(p - left), abs(p - b), abs(p - corner))
                    guess = (left, b, corner)[near.index(min(near))]
                left, corner = (int(line[x]) + guess) & 255, b
                line[x] = left
            y += 1
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit image without interlacing."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(body) != size or crc != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"damaged chunk {kind!r}")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("the header is not the first chunk")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("the header has another size")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole grey 8-bit image")
    if at != len(data):
        raise ValueError("bytes after the end of the image")
    width, height = head[:2]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8)
    except zlib.error as e:
        raise ValueError("damaged image data") from e
    if lines.size != height * (width + 1):
        raise ValueError("the image has another size than its header says")
    return _unfilter(lines.reshape(height, width + 1))


def _averaging(n: int, size: int) -> np.ndarray:
    """Weights (size x n) that average n samples down, or spread them out, to ``size``."""
    edges = np.linspace(0, n, size + 1)
    i = np.arange(n)
    part = np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, 1)
    return part / part.sum(1, keepdims=True)


_K = np.arange(32)
COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:8, None] / 64)
_ACROSS = _averaging(WIDTH, 32)
#: Lines that are averaged at a time.
_LINES = 1 << 16


def _rows32(samples: np.ndarray) -> np.ndarray:
    """The image averaged down to 32 lines; tall ones from prefix sums, block by block."""
    height = len(samples)
    if height <= 64:
        return _averaging(height, 32) @ samples
    edges = np.linspace(0, height, 33)
    low, part = edges.astype(np.int64), edges - edges.astype(np.int64)
    sums, total = np.zeros((33, samples.shape[1])), np.zeros(samples.shape[1])
    for start in range(0, height, _LINES):
        block = np.cumsum(samples[start : start + _LINES], axis=0, dtype=np.int64)
        for e in np.flatnonzero((low > start) & (low <= start + len(block))):
            sums[e] = total + block[low[e] - start - 1]
        total = total + block[-1]
    inside = low < height
    sums[inside] += part[inside, None] * samples[low[inside]]
    return np.diff(sums, axis=0) / (height / 32)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest frequencies, the mean left out, are above their median."""
    low = (COSINES @ (_rows32(samples) @ _ACROSS.T) @ COSINES.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 text, filled up with zeros to whole lines, as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            media = [encode_png(np.frombuffer(payload(t), dtype=np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the
    last 64 samples), media_bytes, media_sha256, feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for data in batch.column("media"):
                data = data.as_py()
                samples = decode_png(data)
                raw = samples.tobytes()
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
