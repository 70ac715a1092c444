import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibweave.llm import mjpeg, queries


def bit_by_bit(jpeg):
    """A plain decoder of one lossless frame, from the tables in its own headers."""
    at, scan = 2, None
    while scan is None:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xC3:
            rows, width = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            codes, code, k = {}, 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    codes[n, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xDA:
            assert body[3] == 1
            scan = jpeg[at + 2 + size : -2].replace(b"\xff\0", b"\xff")
        at += 2 + size
    bits = "".join(f"{b:08b}" for b in scan)
    x, p = np.zeros((rows, width), dtype=int), 0
    for r in range(rows):
        for c in range(width):
            n = 1
            while (n, int(bits[p : p + n], 2)) not in codes:
                n += 1
            k = codes[n, int(bits[p : p + n], 2)]
            v = int(bits[p + n : p + n + k] or "0", 2)
            p += n + k
            d = v if k == 0 or v >> (k - 1) else v - (1 << k) + 1
            x[r, c] = d + (x[r, c - 1] if c else x[r - 1, 0] if r else 128)
    assert p == len(bits)
    return x.astype(np.uint8).tobytes()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300) | st.integers(1, 9000).map(lambda n: np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()), min_size=1, max_size=5))
def test_round_trip(texts):
    payloads = [mjpeg.padded(t) for t in texts]
    assert all(len(p) % 64 == 0 and p for p in payloads)
    samples, rows = mjpeg.decode_files(mjpeg.encode_payloads(payloads))
    assert [s.tobytes() for s in samples] == payloads
    assert [sum(r) * 64 for r in rows] == [len(p) for p in payloads]


def test_frames_follow_the_format():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 70).astype(np.uint8).tobytes()
    frames = mjpeg.parse_avi(mjpeg.encode_payloads([payload])[0])
    assert b"".join(map(bit_by_bit, frames)) == payload
    with pytest.raises(ValueError):
        mjpeg.parse_avi(b"RIFF0000WAVE")


def test_shots():
    dark, light = np.zeros(4096, np.uint8), np.full(4096, 200, np.uint8)
    assert mjpeg.shots(np.concatenate([dark] * 6 + [light] * 6), [64] * 12) == [(0, 5), (6, 11)]
    assert mjpeg.shots(np.concatenate([dark] * 5), [64] * 5) == [(0, 4)]


def test_shots_of_short_clips_and_several_cuts():
    tone = lambda v: np.full(4096, v, np.uint8)
    clip = lambda values: mjpeg.shots(np.concatenate([tone(v) for v in values]), [64] * len(values))
    assert clip([0, 200]) == [(0, 0), (1, 1)]
    assert clip([0, 0, 200, 200]) == [(0, 1), (2, 3)]
    assert clip([0] * 3 + [200] * 3 + [0] * 4) == [(0, 2), (3, 5), (6, 9)]
    assert clip([0, 200] * 6) == [(i, i) for i in range(12)]
    # a short last frame of the same kind, whose padding is no picture, is no cut
    rng = np.random.default_rng(2)
    for left in (1, 40, 64, 100, 500):
        text = rng.integers(97, 123, 8192 + left).astype(np.uint8).tobytes()
        samples = np.frombuffer(mjpeg.padded(text), np.uint8)
        assert mjpeg.shots(samples, [64, 64, -(-left // 64)], len(text)) == [(0, 2)]
    # half of a frame moved by a bin stands out among small changes, and doesn't among equal ones
    mixed = lambda part: np.where(np.arange(4096) < 4096 * part, 200, 0).astype(np.uint8)
    frames = lambda parts: mjpeg.shots(np.concatenate([mixed(p) for p in parts]), [64] * len(parts))
    assert frames([0.1, 0.12, 0.1, 0.12, 0.4, 0.42, 0.4, 0.42]) == [(0, 3), (4, 7)]
    assert frames([0.1, 0.4] * 5) == [(0, 9)]


def test_query_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "é" * 50_000), (-3, "x" * 64)], "doc_id long, text string")
    texts = sorted(((r.doc_id or 0), (r.text or "").encode()) for r in docs.select("doc_id", "text").union(odd).collect())
    extra = odd.withColumn("media", F.lit("clash"))
    got = queries.op10_media_mjpeg(spark, sf_dir).collect() + mjpeg.media_column(extra).collect()
    assert len(got) == len(texts)
    by = sorted([((r.doc_id or 0), r) for r in got], key=lambda x: x[0])
    for (k, t), (j, r) in zip(texts, by, strict=True):
        p = t + b"\0" * (-len(t) % 64) or b"\0" * 64
        assert (k, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (j, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    media = mjpeg.media_column(extra, with_media=True).collect()
    assert all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes for r in media)
    assert mjpeg.clip_rows(mjpeg.media_column(odd)).count() >= 4
    assert mjpeg.media_column(odd.where("false")).collect() == []
