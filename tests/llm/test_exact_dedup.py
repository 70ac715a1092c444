import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from bibweave.llm import exact_dedup, queries


def brute(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(k)
    out = []
    for norm, ids in groups.items():
        keep = min((k for k in ids if k is not None), default=None)
        seen = False
        for k in ids:
            first = k == keep and not seen
            seen = seen or first
            out.append((k, keep, len(ids), first, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def test_nulls_ties_repeats_and_clashes(spark):
    rows = [(3, None), (1, ""), (7, " "), (8, "\t\n"), (5, "a b"), (4, "a  b"), (9, "a\u00a0b"), (None, "a b"), (None, "z"), (None, "z"), (6, "r"), (6, "r"), (6, "other"), (2, " a b"), (10, "é" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_h": F.lit(1), "keep_id": F.lit(2), "_norm": F.lit("x"), "kept": F.lit(True)})
    got = sorted(map(tuple, exact_dedup.duplicate_groups(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(k or 0 for k, _, _, first, _ in got if first)
    assert exact_dedup.duplicate_groups(docs.where("false")).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.ORACLES['op8_exact_dedup']})").fetchall()
    assert sorted(map(tuple, queries.op8_exact_dedup(spark, sf_dir).collect())) == sorted(want)
