"""Quality classifier by compression: text like the good sample shrinks more with the good sample's dictionary.

zstandard dictionaries are trained on good and on bad labelled texts. A text is compressed with each; the difference of the
sizes, normalised by the text's length, is the score, calibrated by a logistic step on labelled texts that the dictionaries have
not seen. The calibration has one more term, the compressed share itself: junk that repeats one word shrinks to nothing with
either dictionary and shows no difference.

Bounds: ``sample`` labelled rows of each label (by hash order of the id), whole texts of at most ``most_bytes`` together, reach
the driver for fitting; every whole text is scored, in slices of a few megabytes. Defined results: null and empty texts score as the empty text; with labels of
one kind only, every score is that label's share (0.5 without labels). Null labels and null ids teach nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bibweave.llm.wordbytes import pieces

LEVEL = 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, bytes, int]]:
    """(hash, text, label) of at most ``sample`` rows of each label among the ids that ``learn`` admits, in hash order, each text
    whole; in all at most ``most_bytes``, of which one text may take an eighth (longer ones are not chosen)."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(learn & F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64(F.lit(label), "_id"))
    parts = [known.where(F.col("_y") == y).orderBy("_h", "_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample rows
    text = F.encode(F.coalesce(text_col, F.lit("")), "utf-8")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).join(chosen, "_id").where(F.length("_t") <= most_bytes // 8)
    # ids may repeat in docs: one text of each, so the bound holds
    rows = rows.groupBy("_id", "_h", "_y").agg(F.min("_t").alias("_t"))
    upto = F.sum(F.length("_t")).over(Window.orderBy("_h", "_id"))  # 2 * sample rows at most
    return sorted((r["_h"], bytes(r["_t"]), r["_y"]) for r in rows.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).collect())


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    constant: float | None = None

    def features(self, texts: list[bytes]) -> np.ndarray:
        """1, the difference of the two compressed sizes and the size with the good dictionary, both by the text's length."""
        good, bad = compressors(self.good, self.bad)
        sizes = np.array([(len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], dtype=np.float64).reshape(-1, 3)
        g, b, n = sizes.T
        return np.stack([np.ones(len(n)), (b - g) / (n + 8), g / (n + 8)], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


@lru_cache(maxsize=2)
def compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    """One pair per Python worker."""
    plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (good, bad))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary trained on the whole texts, in pieces of 2 KB; with too few pieces for training, the pieces themselves."""
    cut = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    cut = [c for c in cut if c]
    while size >= 1024 and len(cut) >= 8:
        try:
            return zstandard.train_dictionary(min(size, sum(map(len, cut)) // 8), cut).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b" ".join(cut)[: max(size, 1024)] or b" "


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Newton's method on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = w / scale
    out[0] -= (w * mean / scale)[1:].sum()
    return out


def fit(rows: list[tuple[int, bytes, int]], dictionary_bytes: int = 112_640) -> CompressionModel:
    """Dictionaries from every second row of each label, calibration on the others."""
    by = {y: [t for _, t, label in rows if label == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return CompressionModel(b" ", b" ", np.zeros(3), 0.5 if not rows else float(bool(by[1])))
    seen = {y: by[y][::2] for y in by}
    rest = {y: by[y][1::2] or by[y] for y in by}
    model = CompressionModel(_dictionary(seen[1], dictionary_bytes), _dictionary(seen[0], dictionary_bytes), np.zeros(3))
    y = np.array([0.0] * len(rest[0]) + [1.0] * len(rest[1]))
    model.weights = logistic(model.features(rest[0] + rest[1]), y)
    return model


def score_column(spark, model: CompressionModel, text: Column) -> Column:
    held = spark.sparkContext.broadcast(model)  # two dictionaries and three weights

    # a plain function of the column as it is: beside another one over the same text it shares its worker and its batches
    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [held.value.scores([(t or "").encode() for t in part.column(0).to_pylist()]) for part in pieces(batch, "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def weight_on(docs: DataFrame, labels: DataFrame, least: float = 0.05, **options) -> Callable[[Column], Column]:
    """From a text to its sampling weight: the score of a model fitted on docs and labels, ``least`` at least."""
    model = fit_on(docs, labels, **options)
    return lambda text: F.greatest(F.lit(least), score_column(docs.sparkSession, model, text))


def learn_rows(ident: Column) -> Column:
    """Ids that may teach: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(ident.cast("string")) % 3 != 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_bytes: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    return fit(labelled_sample(docs, labels, "quality", learn_rows(F.col("_id")), sample, most_bytes, id_col, text_col))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit_on(docs, labels, sample, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
