"""Word hashes and word counts of Arrow text columns, vectorised over the UTF-8 bytes.

Words are maximal runs of bytes outside ASCII white space (0x20, 0x09-0x0D), so multi-byte characters are never cut. Hashes
are 64 bit, equal on every machine, and independent of how rows are batched. Work goes in slices of about a quarter of a megabyte, so
memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORDY = np.zeros(256, dtype=bool)  # letters, digits and all bytes of multi-byte characters
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True

SLICE = 1 << 18
SPAN = 4096
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


SAME = np.arange(256, dtype=np.uint8)
POWERS = _powers(BASE, SPAN)
LEAP = (POWERS[-1:] * BASE)[0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the n + 1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words end where their text does."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    w = inside[raw]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = w[cut]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cut - 1] = w[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    raw, offsets = text_bytes(column)
    starts, _ = word_spans(raw, offsets, ~SPACE)
    return np.diff(np.searchsorted(starts, offsets))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, mapped through table."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + SLICE)))
        s, e = starts[a:b], ends[a:b]
        size = e - s
        # one entry per byte of these words, without the gaps between them
        begin = np.zeros(len(s), dtype=np.int64)
        np.cumsum(size[:-1], out=begin[1:])
        place = np.arange(int(size.sum()), dtype=np.int64)
        within = place - np.repeat(begin, size)
        value = (table[raw[place + np.repeat(s - begin, size)]]).astype(np.uint64) + np.uint64(1)
        if size.max() <= SPAN:
            value *= POWERS[within]
        else:
            value *= POWERS[within % SPAN] * _powers(LEAP, int(size.max()) // SPAN + 1)[within // SPAN]
        out[a:b] = mixed(np.add.reduceat(value, begin) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        a = b
    return out


def hashed_words(column: pa.Array, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased), and for each text the n + 1 positions where its words begin."""
    raw, offsets = text_bytes(column)
    starts, ends = word_spans(raw, offsets, ~SPACE if inside is None else inside)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (a longer text makes a slice alone)."""
    column = batch.column(batch.schema.names.index(text))
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += int(n)
    if a < batch.num_rows:
        yield batch.slice(a)
