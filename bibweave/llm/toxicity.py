"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is looked up by the hash of itself and of its first five and four bytes, so inflected forms share what they learn.
Filters of widths 1 to 3 slide over the words; each filter's maximum over the text, through a ReLU, feeds a logistic output.
Texts are told apart by a coarse guess of their language from frequent short words, and the threshold of each
guessed language is calibrated on labelled texts kept from training; a score is shifted by its threshold so that 0.5 decides.
Embeddings and filters are multiplied out once, so scoring is a sum of table rows per word.

Bounds: ``sample`` labelled rows of each label, whole texts of at most ``most_bytes`` together, reach the driver; every whole
text is scored. Defined results: null, empty and wordless texts score as no words; with labels of one kind only every score
is that label's share (0.5 without labels). Null labels and ids teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bibweave.llm.quality import labelled_sample
from bibweave.llm.wordbytes import WORDY, pieces, span_hashes, text_bytes, word_spans

SLOTS = 1 << 16
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 8
PREFIXES = (None, 5, 4)
#: Short words that mark a language (fixed values): the guess only picks a threshold.
MARKS = {"de": b"der die das und ist nicht ein eine zu den", "fr": b"le les la des et du une est dans que", "es": b"el los las de la y una es en del", "en": b"the of and to in is that it for was"}


def word_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word (one column per prefix rule) and the n + 1 positions where each text's words begin."""
    raw, offsets = text_bytes(column)
    starts, ends = word_spans(raw, offsets, WORDY)
    slots = np.empty((len(PREFIXES), len(starts)), dtype=np.int32)
    for i, n in enumerate(PREFIXES):
        slots[i] = (span_hashes(raw, starts, ends if n is None else np.minimum(ends, starts + n)) >> np.uint64(48)).astype(np.int32)
    return slots, np.searchsorted(starts, offsets)


def guessed_language(slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text the language most of whose marks it has (0 for none)."""
    counts = []
    for words in MARKS.values():
        marks, _ = word_slots(pa.array([words.decode()]))
        hit = np.concatenate(([0], np.cumsum(np.isin(slots[0], marks[0]))))
        counts.append(hit[at[1:]] - hit[at[:-1]])
    counts = np.array(counts)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0) + 1, 0)


@dataclass
class ConvModel:
    embed: list[np.ndarray]
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(MARKS) + 1))
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = 5) -> ConvModel:
        rng = np.random.default_rng(seed)
        return cls(
            [rng.normal(0, 0.1, (SLOTS, SIZE)).astype(np.float32) for _ in PREFIXES],
            [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
            np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32),  # at first every filter speaks for the label
            -1.0,
        )

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset: what a word adds to each filter, one table per prefix rule."""
        return [[[e @ f[k] for e in self.embed] for k in range(len(f))] for f in self.filters]

    def pooled(self, tables, slots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text and filter the maximum over its words (0 where it has too few) and its place (-1)."""
        n = len(at) - 1
        best, place = np.zeros((n, len(WIDTHS) * FILTERS), dtype=np.float32), np.full((n, len(WIDTHS) * FILTERS), -1, dtype=np.int64)
        lengths = np.diff(at)
        for i, w in enumerate(WIDTHS):
            long = np.flatnonzero(lengths >= w)
            if not len(long):
                continue
            m = slots.shape[1] - w + 1
            values = np.zeros((m, FILTERS), dtype=np.float32)
            for k in range(w):
                for rule, table in enumerate(tables[i][k]):
                    values += table[slots[rule, k : k + m]]
            for row in long:  # a text's windows are consecutive
                own = values[at[row] : at[row + 1] - w + 1]
                top = own.argmax(axis=0)
                best[row, i * FILTERS : (i + 1) * FILTERS] = own[top, np.arange(FILTERS)] + self.bias[i]
                place[row, i * FILTERS : (i + 1) * FILTERS] = at[row] + top
        return best, place

    def logits(self, tables, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        best, place = self.pooled(tables, slots, at)
        return np.where(place >= 0, np.maximum(best, 0), 0) @ self.out + self.out_bias

    def scores(self, tables, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        slots, at = word_slots(column)
        z = self.logits(tables, slots, at) - self.thresholds[guessed_language(slots, at)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def train(model: ConvModel, slots: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 3) -> None:
    """Adam on the logistic loss, both labels weighing the same; the gradient flows through the words that won the maxima."""
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    small = [*model.filters, *model.bias, model.out]
    first, second = [np.zeros_like(p) for p in small], [np.zeros_like(p) for p in small]
    squares = [np.full(SLOTS, 1e-8, dtype=np.float32) for _ in model.embed]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            words = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows]).astype(np.int64)
            own = slots[:, words]
            begin = np.concatenate(([0], np.cumsum(at[rows + 1] - at[rows])))
            best, place = model.pooled(_Lazy(model, own), np.arange(own.shape[1])[None, :], begin)
            hidden = np.where(place >= 0, np.maximum(best, 0), 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            error = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads = [np.zeros_like(g) for g in small]
            grads[-1] = hidden.T @ error
            back = np.where((place >= 0) & (best > 0), error[:, None] * model.out[None, :], 0)
            pull = [[], []]
            for i, w in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                r, f = np.nonzero(part)
                value, where = part[r, f], place[r, i * FILTERS + f]
                np.add.at(grads[len(WIDTHS) + i], f, value)
                for k in range(w):
                    word = own[:, where + k]
                    vector = sum(e[word[j]] for j, e in enumerate(model.embed))
                    np.add.at(grads[i], (k, slice(None), f), value[:, None] * vector)
                    pull[0].append(word)
                    pull[1].append(value[:, None] * model.filters[i][k][:, f].T)
            step += 1
            for q, g, a, b in zip(small, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            model.out_bias -= rate * float(error.sum())
            if pull[0]:
                word, vector = np.concatenate(pull[0], axis=1), np.concatenate(pull[1])
                for j, e in enumerate(model.embed):
                    slot, inverse = np.unique(word[j], return_inverse=True)
                    g = np.zeros((len(slot), SIZE), dtype=np.float32)
                    np.add.at(g, inverse, vector)
                    squares[j][slot] += (g * g).sum(axis=1)
                    e[slot] -= 5 * rate * g / np.sqrt(squares[j][slot])[:, None]


class _Lazy:
    """Tables of one batch: row i is what its word i adds, so training multiplies only the words it sees."""

    def __init__(self, model: ConvModel, own: np.ndarray):
        vector = sum(e[own[j]] for j, e in enumerate(model.embed))
        self.parts = [[[vector @ f[k]] for k in range(len(f))] for f in model.filters]

    def __getitem__(self, i: int):
        return self.parts[i]


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the most right decisions, in the middle of its gap."""
    if not len(z):
        return 0.0
    order = np.argsort(z)
    z, y = z[order], y[order]
    right = np.concatenate(([y.sum()], y.sum() + np.cumsum(1 - 2 * y)))
    top = np.flatnonzero(right == right.max())
    edges = np.concatenate(([z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]))
    return float(edges[top[len(top) // 2]])


def fit(rows: list[tuple[int, bytes, int]]) -> ConvModel:
    model = ConvModel.fresh()
    y = np.array([label for _, _, label in rows], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        model.constant = 0.5 if not len(y) else float(y[0])
        return model
    slots, at = word_slots(pa.array([t.decode("utf-8", "ignore") for _, t, _ in rows]))
    kept = np.arange(len(y)) % 4 == 3  # calibrates

    def of(mask):
        own = np.flatnonzero(mask)
        words = np.concatenate([np.arange(at[r], at[r + 1]) for r in own] or [np.zeros(0)]).astype(np.int64)
        return slots[:, words], np.concatenate(([0], np.cumsum(at[own + 1] - at[own]))), y[own]

    train(model, *of(~kept))
    held, begin, truth = of(kept)
    z, language = model.logits(model.tables(), held, begin), guessed_language(held, begin)
    overall = best_threshold(z, truth)
    for k in range(len(model.thresholds)):
        own = language == k
        enough = own.sum() >= 20 and 0 < truth[own].sum() < own.sum()
        model.thresholds[k] = best_threshold(z[own], truth[own]) if enough else overall
    return model


def learn_rows(ident: Column) -> Column:
    """Ids that may teach: crc32 of the id as text, mod 5, is not 0."""
    return F.coalesce(F.crc32(ident.cast("string")) % 5 != 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = 2500, most_bytes: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text") -> ConvModel:
    return fit(labelled_sample(docs, labels, "toxic", learn_rows(F.col("_id")), sample, most_bytes, id_col, text_col))


def score_column(spark, model: ConvModel, text: Column) -> Column:
    held = spark.sparkContext.broadcast(model)  # fixed size

    @F.arrow_udf(DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = held.value.tables()
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [held.value.scores(tables, part.column(0)) for part in pieces(batch, "text", 1 << 20)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit_on(docs, labels, sample, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
