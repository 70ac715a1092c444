import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from bibweave.llm import quality, queries, toxicity
from bibweave.llm.quality import score_quality
from bibweave.llm.toxicity import score_toxicity

CASES = [(queries.op7_toxicity, "toxic", 5, 0), (queries.op9_quality, "quality", 3, 1)]


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("query", "label", "mod", "held"), CASES)
def test_held_out_accuracy(spark, query, label, mod, held):
    sf = "/root/testdata/sf0.1"
    got = query(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    own = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    score, y = np.array(own).T
    assert auc(score, y) > 0.97 and ((score >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize(("score", "label", "mod", "held"), [(score_toxicity, "toxic", 5, 0), (score_quality, "quality", 3, 1)])
def test_labels_of_held_out_rows_never_matter(spark, sf_dir, score, label, mod, held):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % mod == held
    flipped = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    plain = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "score": F.lit("clash")}).repartition(3)
    a, b = ({r.doc_id: r.score for r in score(d, x).collect()} for d, x in ((docs, labels), (plain, flipped)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


@pytest.mark.parametrize("score", [score_toxicity, score_quality])
def test_odd_rows(spark, score):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "w " * 200_000), (4, "twice"), (5, "good text"), (6, "%%% ***")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (6, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    got = score(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score(docs, none).collect()} == {0.5}
    assert score(docs.where("false"), labels).collect() == []


def test_quality_scores_by_hand(spark, sf_dir):
    """The score of every document again from two compressed sizes and three weights."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_on(docs, labels)
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    plain = {"level": 3, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    sizes = [lambda t, d=d: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain).compress(t)) for d in (model.good, model.bad)]
    for r in docs.collect():
        t = (r.text or "").encode()
        good, bad = (f(t) for f in sizes)
        z = model.weights[0] + model.weights[1] * (bad - good) / (len(t) + 8) + model.weights[2] * good / (len(t) + 8)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_scores_by_hand(spark, sf_dir):
    """The convolution word by word and filter by filter, without tables."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_on(docs, labels)
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    for r in docs.orderBy("n_chars").limit(60).collect():
        slots, at = toxicity.word_slots(pa.array([r.text or ""]))
        words = [sum(e[slots[i, k]] for i, e in enumerate(model.embed)) for k in range(slots.shape[1])]
        z = model.out_bias
        for i, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                windows = [sum(float(words[a + k] @ model.filters[i][k][:, f]) for k in range(width)) for a in range(len(words) - width + 1)]
                if windows:
                    z += max(0.0, max(windows) + model.bias[i][f]) * model.out[i * toxicity.FILTERS + f]
        z -= model.thresholds[toxicity.guessed_language(slots, at)[0]]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_sample_takes_whole_texts_within_its_bound(spark):
    rows = [(k, "w" * (100 if k % 2 else 5000)) for k in range(40)]
    docs = spark.createDataFrame([*rows, (1, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3 % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    taken = quality.labelled_sample(docs, labels, "quality", F.lit(True), 12, 16_000)
    assert 0 < len(taken) <= 24 and sum(len(t) for _, t, _ in taken) <= 16_000
    assert {len(t) for _, t, _ in taken} <= {100, 5} and taken == sorted(taken)
