"""Token counts of whole texts for a BPE with word ends, by the whole-token shortcut.

The tokenizer lower-cases, drops white space and merges inside pre-tokens only, so a text's count is the sum over its
pre-tokens. ``whole_tokens`` proves, before the job, which vocabulary strings encode alone as exactly one token: each is put
through the tokenizer itself. A pre-token among them counts 1 without being merged; the others are merged by the library, once
each per worker as long as ``KNOWN`` of them are remembered.

Where pre-tokens begin is seen in the bytes for plain words: printable ASCII without the apostrophe, and the letters from
U+00C0 to U+00FF. There letters make one pre-token, each digit one, other characters one together, and nothing is composed by
NFC. Every other word between ASCII white space (contractions, other scripts, combining marks, control characters, the
special tokens' strings) is counted by the library as a whole: white space always separates pre-tokens.

Defined results: null text is empty and has no tokens; rows may repeat and ids may be null; further columns don't matter; an
empty table gives no rows. Texts are worked on in slices cut at white space, so memory is bounded by a slice and the longest
word.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibweave.llm.wordbytes import LOWER, SPACE, pieces, text_bytes, word_spans

KNOWN = 400_000
LIMIT = 2048
SLICE = 1 << 20
#: Classes of bytes: 1 letters, 2 digits, 3 other printable ASCII, 0 white space and all that makes a word odd.
KIND = np.zeros(256, dtype=np.uint8)
KIND[33:127] = 3
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[39] = 0
LEAD = 0xC3  # first byte of U+00C0 to U+00FF
LATIN = np.zeros(256, dtype=bool)  # second bytes that make a letter: all but the signs for times and division
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[0x80:0x9F] = True


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_alone(tokenizer, texts: list[str]) -> np.ndarray:
    """Tokens of each text by the library."""
    return np.array([len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], dtype=np.int64)


def whole_tokens(path: str) -> list[str]:
    """The strings of the vocabulary that encode alone as one token: the proof of the shortcut, one encoding per entry."""
    tokenizer = load(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    suffix = tokenizer.model.end_of_word_suffix or ""
    # byte-level vocabularies write every byte as one character
    back = {c: b for b, c in byte_characters().items()}
    texts = set()
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith(suffix) and entry not in special:
            try:
                texts.add(bytes(back[c] for c in entry[: len(entry) - len(suffix)]).decode())
            except (KeyError, UnicodeDecodeError):  # part of a character: no text has it as a pre-token
                continue
    texts = sorted(texts - {""} - special)
    return [t for t, n in zip(texts, count_alone(tokenizer, texts).tolist(), strict=True) if n == 1]


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it prints, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Counts the tokens of columns of texts. One per Python worker."""

    def __init__(self, path: str, whole: list[str]):
        self.tokenizer = load(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = pa.array(whole, pa.large_string())
        self.known: dict[str, int] = {}

    def _merged(self, words: list[str]) -> np.ndarray:
        """Counts by the library, remembered."""
        out = [self.known.get(w, -1) for w in words]
        new = [i for i, n in enumerate(out) if n < 0]
        if new:
            counts = count_alone(self.tokenizer, [words[i] for i in new]).tolist()
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
            for i, n in zip(new, counts, strict=True):
                out[i] = n
                self.known[words[i]] = n
        return np.array(out, dtype=np.int64)

    def _spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortcut: bool) -> np.ndarray:
        """The count of each span of bytes: distinct ones are looked up among the whole tokens, then merged."""
        size = ends - starts
        begin = np.concatenate(([0], np.cumsum(size)))
        flat = data[np.arange(begin[-1]) + np.repeat(starts - begin[:-1], size)]
        coded = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(flat)).dictionary_encode()
        distinct = coded.dictionary
        counts = np.ones(len(distinct), dtype=np.int64)
        rest = np.flatnonzero(np.asarray(pc.is_null(pc.index_in(distinct, self.whole)))) if shortcut else np.arange(len(distinct))
        if len(rest):
            counts[rest] = self._merged(distinct.take(pa.array(rest)).to_pylist())
        return counts[np.asarray(coded.indices)]

    def _slice(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of each word (starts, ends) of raw."""
        kind, low = KIND[raw], LOWER[raw]
        lead = np.flatnonzero((raw[:-1] == LEAD) & LATIN[raw[1:]]) if len(raw) else np.zeros(0, dtype=np.int64)
        kind[lead] = kind[lead + 1] = 1
        low[lead[CAPITAL[raw[lead + 1]]] + 1] += 0x20
        odd = np.concatenate(([0], np.cumsum(kind == 0)))
        plain = odd[ends] == odd[starts]
        text = raw.tobytes()
        for mark in self.special:  # their strings are printable; a word that holds one is left to the library
            at = text.find(mark)
            while at >= 0:
                plain[np.searchsorted(starts, at, "right") - 1] = False
                at = text.find(mark, at + 1)
        tokens = np.zeros(len(starts), dtype=np.int64)
        if not plain.all():
            tokens[~plain] = self._spans(raw, starts[~plain], ends[~plain], False)
        if plain.any():
            s, e = starts[plain], ends[plain]
            first = np.zeros(len(raw) + 1, dtype=bool)
            first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            first[s] = True
            inside = np.zeros(len(raw) + 1, dtype=np.int8)
            inside[s] += 1
            inside[e] -= 1
            at = np.flatnonzero(first[:-1] & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
            until = np.minimum(np.append(at[1:], len(raw)), e[np.searchsorted(s, at, "right") - 1])
            total = np.concatenate(([0], np.cumsum(self._spans(low, at, until, True))))
            tokens[plain] = total[np.searchsorted(at, e)] - total[np.searchsorted(at, s)]
        return tokens

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; null texts are empty."""
        raw, offsets = text_bytes(texts)
        starts, ends = word_spans(raw, offsets, ~SPACE)
        tokens = np.zeros(len(starts) + 1, dtype=np.int64)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + SLICE)))
            lo, hi = starts[a], ends[b - 1]
            tokens[a + 1 : b + 1] = self._slice(raw[lo:hi], starts[a:b] - lo, ends[a:b] - lo)
            a = b
        return np.diff(np.cumsum(tokens)[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=4)
def counter(path: str, whole: tuple[str, ...]) -> Counter:
    """One per Python worker and vocabulary file."""
    return Counter(path, list(whole))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit: one row per row of docs, without a shuffle. The proof is made here, once, and
    travels with the tasks: it is no longer than the vocabulary."""
    whole = tuple(whole_tokens(tokenizer))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, whole).count
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(1)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
