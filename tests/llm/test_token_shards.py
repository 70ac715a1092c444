import numpy as np
import pytest
from pyspark.sql import functions as F

from bibweave.llm import queries, token_shards
from tests.llm.test_packing import PATH, crc, plain


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, out = 0, []
    for k, ids in rows:
        out.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = expected(list(zip([d.doc_id for d in docs], plain([d.text for d in docs], 2), strict=True)))
    got = queries.op6_token_shards(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_small_shards_nulls_repeats_and_keyed_access(spark, tmp_path):
    rows = [(5, "b"), (None, "n"), (5, "b"), (-3, None), (9, "x " * 9000), (7, "")] + [(100 + k, f"text {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(0)).withColumn("key", F.lit("k"))
    ids = plain([t for _, t in rows], 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, several shards
    try:
        got = token_shards.round_trip(docs, PATH, path=str(tmp_path / "s"), shard_ids=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected([(k, i) for (k, _), i in zip(rows, ids, strict=True)])
    directory = str(tmp_path / "d")
    token_shards.write_directory(spark, str(tmp_path / "s"), directory)
    found = sorted((r.doc_id, r.ids) for r in token_shards.fetch(spark, directory, [5, 9, 250, 4, 10**12]).collect())
    assert found == sorted((k, i) for (k, _), i in zip(rows, ids, strict=True) if k in (5, 9, 250))
    one = token_shards.fetch(spark, directory, [250])
    assert len(one.inputFiles()) == 1 and spark.read.parquet(directory).count() > 3
    assert token_shards.fetch(spark, directory, [10**12]).collect() == []


def test_id_that_does_not_fit_raises(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    token_shards.write_shards(docs, str(tmp_path / "wide"), PATH, end_id=70_000)
    assert [r.n_tokens for r in token_shards.read_index(spark, str(tmp_path / "wide")).collect()] == [2]
    with pytest.raises(Exception, match="does not fit"):
        token_shards.write_shards(docs, str(tmp_path / "narrow"), PATH, end_id=70_000, id_bytes=2)


def test_empty_table(spark):
    assert token_shards.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    at = token_shards.PerfectHash.of(keys).slots(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
