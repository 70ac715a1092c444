"""Token ids of whole texts with a public byte-level BPE, through the tokenizers library.

The byte-level pre-tokenizer starts a new piece at certain places whatever surrounds them, and the BPE merges only within a
piece. Texts are cut at such places that are cheap to see in the bytes (before a white-space run, after a lone line feed,
between an ASCII letter or digit and punctuation), and a text's ids are those of its chunks in order. Chunks repeat: each is
encoded once per batch, and every Python worker remembers up to ``KNOWN`` of them as sorted hashes beside one array of ids.
The memory is bounded; it changes the time taken and never an id. Texts with white space beyond ASCII or with special tokens
are encoded whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from bibweave.llm.wordbytes import SAME, SPACE, span_hashes, text_bytes

KNOWN = 800_000
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
PUNCT = np.zeros(256, dtype=bool)
PUNCT[33:127] = ~ALNUM[33:127]
CONTROL = np.zeros(256, dtype=bool)
CONTROL[28:32] = True
#: UTF-8 forms of the white space beyond ASCII (fixed values)
WIDE_SPACES = [c.encode() for c in "\x85\xa0                　"]


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which a chunk starts."""
    space = SPACE[raw]
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = space[1:] & ~space[:-1]
    cut[2:] |= (raw[1:-1] == 10) & ~space[2:] & ~space[:-2]
    cut[1:] |= PUNCT[raw[1:]] & ALNUM[raw[:-1]]
    begin = offsets[:-1]
    cut[begin[begin < len(raw)]] = True
    # a line feed that opens a text has nothing before it: what follows stays with it
    second = begin[(begin + 1 < offsets[1:])] + 1
    cut[second[(raw[second - 1] == 10) & ~space[second]]] = False
    return np.flatnonzero(cut)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each token: one character each
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.keys = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The plain way: every text by itself."""
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that the pre-tokenizer separates when they are joined: one call, cut again by the bytes of the tokens."""
        ids = np.array(self.tokenizer.encode("".join(words), add_special_tokens=False).ids, dtype=np.uint32)
        ends = np.cumsum([len(w.encode()) for w in words])
        at = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        return ids, np.diff(at, prepend=0)

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks and the number of ids of each."""
        runs = [i for i, c in enumerate(chunks) if c[0] == " " and c[1:].isalpha()]
        alone = sorted(set(range(len(chunks))) - set(runs))
        ids, counts = [], []
        for i in range(0, len(runs), 4096):
            a, n = self._run([chunks[k] for k in runs[i : i + 4096]])
            ids.append(a)
            counts.append(n)
        rest = self.whole([chunks[k] for k in alone])
        counts.append(np.array([len(x) for x in rest], dtype=np.int64))
        return np.concatenate([*ids, *rest]), np.concatenate(counts), np.array(runs + alone)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and the n + 1 offsets of each text's ids; null texts are empty."""
        raw, offsets = text_bytes(column)
        starts = chunk_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        unique, first, inverse = np.unique(span_hashes(raw, starts, ends, SAME), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        hit = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), dtype=bool)
        start, count = np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=np.int64)
        start[hit], count[hit] = self.start[at[hit]], self.count[at[hit]]
        pool = self.pool
        miss = np.flatnonzero(~hit)
        if len(miss):
            data = raw.tobytes()
            spans = zip(starts[first[miss]].tolist(), ends[first[miss]].tolist(), strict=True)
            ids, n, order = self._learn([data[a:b].decode() for a, b in spans])
            miss = miss[order]
            begin = len(pool) + np.cumsum(n) - n
            start[miss], count[miss] = begin, n
            pool = np.concatenate([pool, ids])
            if len(self.keys) < KNOWN:
                keys = np.concatenate([self.keys, unique[miss]])
                by = np.argsort(keys)
                self.keys, self.start, self.count, self.pool = keys[by], np.concatenate([self.start, begin])[by], np.concatenate([self.count, n])[by], pool
        n = count[inverse]
        total = np.concatenate(([0], np.cumsum(n)))
        flat = pool[np.arange(total[-1]) + np.repeat(start[inverse] - total[:-1], n)]
        bounds = total[np.searchsorted(starts, offsets)]
        return self._odd(column, raw, offsets, flat, bounds)

    def _odd(self, column, raw, offsets, flat, bounds):
        """Encodes again, whole, the texts whose chunks can't be trusted."""
        data = raw.tobytes()
        where = [np.flatnonzero(CONTROL[raw])]
        for mark in (*WIDE_SPACES, *self.special):
            at = data.find(mark)
            while at >= 0:
                where.append(np.array([at]))
                at = data.find(mark, at + 1)
        rows = np.unique(np.searchsorted(offsets, np.concatenate(where), "right") - 1)
        if not len(rows):
            return flat, bounds
        parts = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, ids in zip(rows.tolist(), self.whole([column[i].as_py() for i in rows.tolist()]), strict=True):
            parts[i] = ids
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    return Encoder(path)
