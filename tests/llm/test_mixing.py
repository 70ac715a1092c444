from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bibweave.llm import mixing, quality, queries
from bibweave.llm.mixing import _row_key, mix, quality_weight


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= over
    return out


def check(rows, got, largest):
    sizes = defaultdict(int)
    for source, text in rows:
        sizes[source] += len((text or "").encode().split())
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.size >= 0 and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
        epochs = want[s] // sizes[s] if sizes[s] else 0
        assert all(r.taken >= epochs * r.size for r in got if r.source == s)


def run(df, **options):
    m = mix(df, **options)
    return m.select("source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken")).collect()


@pytest.mark.parametrize("buckets", [4, 1024])
def test_targets_and_budgets(spark, sf_dir, buckets):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.source, r.text) for r in docs.collect()]
    largest = defaultdict(int)
    for s, t in rows:
        largest[s] = max(largest[s], len((t or "").encode().split()))
    got = run(docs, buckets=buckets)
    assert len(got) == len(rows)
    check(rows, got, largest)
    assert sorted(map(tuple, got)) == sorted(map(tuple, run(docs.repartition(5), buckets=buckets)))


@pytest.mark.parametrize(("buckets", "enough"), [(4, 3), (1024, 1 << 16)])
def test_takes_the_smallest_keys(spark, sf_dir, buckets, enough):
    """Complete epochs, then the prefix of the key order whose sum is nearest the fraction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 7 > 0").unionByName(
        spark.range(3000).selectExpr("id + 100000 AS doc_id", "repeat('%$# ', cast(id % 5 + 1 AS int)) AS text", "'xx' AS lang", "'junk' AS source", "0L AS n_chars")
    )
    got = {r.doc_id: r for r in mix(docs, buckets=buckets, enough=enough).collect()}
    keys = docs.select("doc_id", "source", _row_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), 17).alias("key")).collect()
    assert all(0 <= r.key < 1 for r in keys)
    for source in {r.source for r in keys}:
        rows = sorted((r.key, got[r.doc_id].mix_size, got[r.doc_id].mix_copies) for r in keys if r.source == source and got[r.doc_id].mix_size)
        one = next(got[r.doc_id] for r in keys if r.source == source)
        epochs, rest = divmod(one.mix_target, one.mix_source_size)
        upto, want = 0, []
        for _, size, _ in rows:
            if upto < rest and upto + size - rest < rest - upto:
                want.append(epochs + 1)
                upto += size
            else:
                upto = max(upto, rest)
                want.append(epochs)
        assert [c for *_, c in rows] == want
    assert sum(r.mix_copies for r in got.values() if r.source == "junk") > 0


def test_junk_spreads_over_cells(spark):
    rows = spark.range(20_000).select(_row_key(F.col("id"), F.lit("%$#"), F.lit(0.05), 17).alias("key")).groupBy(F.floor(F.col("key") * 1024)).count()
    assert rows.agg(F.max("count")).first()[0] < 600


def test_query_columns(spark, sf_dir):
    assert queries.op4_source_mixing(spark, sf_dir).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, "a b c", None), (1, None, "é"), (1, "x", "z"), (1, "x", "z"), (2, "", "a"), (3, "many words in this one " * 40, "a"), (4, "q " * 30, "Z"), (5, "r s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("?"), "key": F.lit("?"), "target": F.lit("?")})
    largest = defaultdict(lambda: 1000)
    check([(s, t) for _, t, s in rows], run(docs), largest)
    assert mix(docs).columns == [*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    assert run(spark.createDataFrame([], "doc_id long, text string, source string")) == []
    assert all(r.taken == 0 and r.target == 0 for r in run(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")))


def test_counts_and_scores_share_one_pass_over_the_text(spark):
    docs = spark.createDataFrame([(i, None if i == 3 else f"some good words {i}", "a") for i in range(12)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    planned = mixing._planned(docs, weigh=quality.weight_on(docs, labels))
    assert planned._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert planned.count() == 12
