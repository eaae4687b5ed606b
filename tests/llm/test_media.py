import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from corpuslake.llm import media


def test_all_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 64)).astype(np.int64)
    kinds, lines = np.arange(40) % 5, np.empty((40, 65), dtype=np.uint8)
    for y in range(40):
        for x in range(64):
            a, b, c = image[y, x - 1] if x else 0, image[y - 1, x] if y else 0, image[y - 1, x - 1] if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (image[y, x] - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
        lines[y, 0] = kinds[y]
    assert (media._unfilter(lines) == image).all()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 2_000_000])
def test_round_trip(n):
    raw = media.payload("x" * n)
    assert len(raw) % 64 == 0 and len(raw) == max(64, -(-n // 64) * 64)
    data = media.encode_png(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 64))
    assert media.decode_png(data).tobytes() == raw


def test_damage_is_found():
    data = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for i in range(0, len(data), 5):
        with pytest.raises(ValueError):
            media.decode_png(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    for cut in range(len(data)):
        with pytest.raises(ValueError):
            media.decode_png(data[:cut])
    with pytest.raises(ValueError):
        media.decode_png(data + b"x")
    broken = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 2, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", b"no zlib data") + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.decode_png(broken)


def direct_hash(samples):
    """The hash from the transform's definition, a sum for each frequency."""
    h, w = samples.shape
    small = np.zeros((32, 32))
    for i in range(32):
        for j in range(32):
            total = 0.0
            for y in range(int(i * h / 32), min(h, math.ceil((i + 1) * h / 32))):
                part = min((i + 1) * h / 32, y + 1) - max(i * h / 32, y)
                total += part * (float(samples[y, 2 * j]) + float(samples[y, 2 * j + 1])) / 2
            small[i, j] = total / (h / 32)
    low = [sum(small[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    low = [round(x, 6) for x in low]
    median = sorted(low[1:])[31]
    bits = [0] + [int(x > median) for x in low[1:]]
    return f"{int(''.join(map(str, bits)), 2):016x}"


@pytest.mark.parametrize("height", [1, 5, 32, 64, 65, 200])
def test_feature_is_the_cosine_transform(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, 64)).astype(np.uint8)
    assert media.cosine_hash(samples) == direct_hash(samples)


def test_averaging_of_tall_images():
    samples = np.random.default_rng(2).integers(0, 256, (1000, 64)).astype(np.uint8)
    assert np.allclose(media._rows32(samples), media._averaging(1000, 32) @ samples)


def test_features(odd, empty):
    rows = media.features(media.encode(odd)).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for d in odd.collect():
        raw = media.payload(d.text)
        if d.doc_id is not None:
            r = by_id[d.doc_id]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert by_id[1].media_sha256 == by_id[7].media_sha256 and by_id[1].feature == by_id[7].feature
    assert media.features(media.encode(empty)).count() == 0
