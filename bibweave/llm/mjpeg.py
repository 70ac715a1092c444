"""Media columns: payloads in AVI motion-JPEG containers, written and read losslessly, with shots from frame histograms.

A payload of 8-bit samples is laid out as rows of ``WIDTH`` samples; up to ``ROWS`` rows make a frame. Frames are lossless
JPEG (process SOF3, predictor 1), so every frame is an intra frame that decodes alone. Its Huffman table gives category k a
code of 9 - k bits: with its k extra bits a sample always takes 9 bits, which numpy packs and unpacks for a whole batch. The
container is RIFF AVI: headers, a ``movi`` list of ``00dc`` chunks and an ``idx1`` index, by which the reader finds frames.

Shots: a frame starts a shot when its histogram differs from the last frame's by more than a floor (which allows for the
sampling error of a short last frame, whose padding doesn't count) and, with ``FEW`` other differences or more in ``NEAR`` places
to each side, by more than their median plus ``SHARP`` deviations (1.4826 times the median absolute deviation); a difference
over ``HARD`` needs the floor alone. Each shot is a clip row with times at ``FPS`` frames a second.

Defined results: null and empty texts are one block of 64 zero bytes; equal texts give equal media. A container whose chunks
or tables aren't of this form raises an error rather than yield wrong samples. Extra columns don't matter.
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

from bibweave.llm.wordbytes import pieces

WIDTH = 64
ROWS = 64
FPS = 25
BITS = 9
BINS = 16
SHARP = 3.0
FLOOR = 0.25
HARD = 1.0  # half of a frame's samples in other bins
NEAR = 8
FEW = 5


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit codeword of each difference (index difference + 255), and the difference of each codeword."""
    code, difference = np.zeros(511, dtype=np.uint16), np.zeros(512, dtype=np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        prefix = (1 << (BITS - k)) - 2  # 8 - k ones and a zero
        code[d + 255] = prefix << k | (d if d >= 0 else d + (1 << k) - 1)
        difference[code[d + 255]] = d
    return code, difference


CODE, DIFFERENCE = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(rows: int) -> bytes:
    """SOI, SOF3 (8 bits, one component), DHT (one code of each length 1 to 9: categories 8 down to 0), SOS (predictor 1)."""
    frame = _segment(0xC3, struct.pack(">BHHBBBB", 8, rows, WIDTH, 1, 1, 0x11, 0))
    table = _segment(0xC4, bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
    return b"\xff\xd8" + frame + table + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


HEADS = {r: _jpeg_head(r) for r in range(1, ROWS + 1)}
HEAD_SIZE = len(HEADS[1])


def packed(samples: np.ndarray, first_rows: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes of rows of samples, 72 bytes a row; first_rows marks the rows that open a frame."""
    x = samples.reshape(-1, WIDTH).astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[first_rows, 0] = x[first_rows, 0] - 128
    c = CODE[d + 255].reshape(-1, 8)
    out = np.empty((len(c), BITS), dtype=np.uint8)
    for j in range(BITS):  # byte j holds the end of code j - 1 and the start of code j
        head = c[:, j] >> (j + 1) if j < 8 else 0
        tail = c[:, j - 1] << (8 - j) if j else 0
        out[:, j] = (head | tail) & 255
    return out.reshape(-1)


def unpacked(data: np.ndarray, first_rows: np.ndarray) -> np.ndarray:
    """The samples again, of 72 bytes a row."""
    b = data.reshape(-1, BITS).astype(np.uint16)
    c = np.empty((len(b), 8), dtype=np.uint16)
    for j in range(8):
        c[:, j] = (b[:, j] << (j + 1) | b[:, j + 1] >> (7 - j)) & 511
    d = DIFFERENCE[c].reshape(-1, WIDTH).astype(np.int64)
    d[first_rows, 0] += 128
    total = np.cumsum(d[:, 0])
    before = total[first_rows] - d[first_rows, 0]  # of each frame: what the frames above add up to
    d[:, 0] = total - np.repeat(before, np.diff(np.append(first_rows, len(d))))
    return (np.cumsum(d, axis=1) & 255).astype(np.uint8).reshape(-1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes]) -> bytes:
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, ROWS, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, ROWS)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, ROWS, 1, 8, b"MJPG", WIDTH * ROWS, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    at, index, body = 4, [], [b"movi"]
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<3I", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> list[bytes]:
    """The frames, by the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, frames = 12, None, []
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1" and movi is not None:
            for _, _, offset, length in struct.iter_unpack("<4s3I", data[at + 8 : at + 8 + size]):
                begin = movi + offset + 8
                frames.append(data[begin : begin + length])
        at += 8 + size + (size & 1)
    return frames


def frame_rows(jpeg: bytes) -> int:
    rows = int.from_bytes(jpeg[7:9], "big")
    if jpeg[:HEAD_SIZE] != HEADS.get(rows) or jpeg[-2:] != b"\xff\xd9":
        raise ValueError("not a frame of this form")
    return rows


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload (a positive multiple of WIDTH bytes)."""
    rows = np.array([len(p) // WIDTH for p in payloads], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(rows)))
    first = np.concatenate([np.arange(a, b, ROWS) for a, b in zip(begin, begin[1:], strict=False)])
    coded = packed(np.frombuffer(b"".join(payloads), dtype=np.uint8), first).tobytes()
    step, out = WIDTH * BITS // 8, []
    for a, b in zip(begin.tolist(), begin[1:].tolist(), strict=False):
        out.append(avi([HEADS[min(ROWS, b - r)] + coded[r * step : min(r + ROWS, b) * step].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for r in range(a, b, ROWS)]))
    return out


def decode_files(files: list[bytes]) -> tuple[list[np.ndarray], list[list[int]]]:
    """The samples of each file, and the rows of its frames."""
    scans, rows, per_file = [], [], []
    for data in files:
        frames = parse_avi(data)
        own = [frame_rows(f) for f in frames]
        scans += [f[HEAD_SIZE:-2].replace(b"\xff\0", b"\xff") for f in frames]
        rows += own
        per_file.append(own)
    if not scans:
        return [], per_file
    first = np.cumsum([0, *rows[:-1]])
    samples = unpacked(np.frombuffer(b"".join(scans), dtype=np.uint8), first)
    ends = np.cumsum([sum(r) for r in per_file]) * WIDTH
    return np.split(samples, ends[:-1]), per_file


def shots(samples: np.ndarray, rows: list[int], size: int | None = None) -> list[tuple[int, int]]:
    """First and last frame of each shot; samples from ``size`` on are padding."""
    if len(rows) < 2:
        return [(0, len(rows) - 1)]
    frame = np.repeat(np.arange(len(rows)), np.array(rows) * WIDTH)[:size]
    histogram = np.bincount(frame * BINS + (samples[:size] >> 4), minlength=len(rows) * BINS).reshape(-1, BINS)
    n = histogram.sum(axis=1)
    share = histogram / n[:, None]
    change = np.abs(np.diff(share, axis=0)).sum(axis=1)
    floor = FLOOR + np.sqrt(BINS / np.minimum(n[1:], n[:-1]))
    cut = []
    for i in np.flatnonzero(change > floor).tolist():
        others = np.concatenate((change[max(0, i - NEAR) : i], change[i + 1 : i + 1 + NEAR]))
        middle = np.median(others) if len(others) >= FEW else 0.0
        spread = np.median(np.abs(others - middle)) if len(others) >= FEW else 0.0
        if change[i] > max(floor[i], HARD) or change[i] > middle + SHARP * 1.4826 * spread:
            cut.append(i + 1)
    edges = [0, *cut, len(rows)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def _run(with_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = encode_payloads([padded(t) for t in texts])
                samples, rows = decode_files(media)
                out = []
                for t, m, s, r in zip(texts, media, samples, rows, strict=True):
                    data = s.tobytes()
                    clips = [{"clip": i, "first_frame": a, "last_frame": b, "start_s": a / FPS, "end_s": (b + 1) / FPS} for i, (a, b) in enumerate(shots(s, r, len(t) or None))]
                    out.append((len(t), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), len(r), clips))
                columns = [part.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), KINDS, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(media, pa.binary())] if with_media else [])], [*NAMES, *(["media"] if with_media else [])])

    return run


CLIP = pa.struct([("clip", pa.int64()), ("first_frame", pa.int64()), ("last_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(CLIP)]
NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "clips"]


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row per document, from its stored and read media: the columns of NAMES (clips: array of timed shots), and the file
    itself with ``with_media``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    clips = "array<struct<clip: long, first_frame: long, last_frame: long, start_s: double, end_s: double>>"
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, clips {clips}"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(with_media), schema + ", media binary" * with_media)


def clip_rows(media: DataFrame) -> DataFrame:
    """One row per shot: doc_id, clip, first_frame, last_frame, start_s, end_s."""
    return media.select("doc_id", F.inline("clips"))
