"""What large tables do to a plan, on small rows with small limits."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from bibweave.operators import compare, labels, linkage
from bibweave.plans import curated
from bibweave.session import persisted
from bibweave.sources.snapshots import aligned


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def wide_works(spark, n: int):
    """Works whose files are small: a row is mostly what others hold too."""
    return spark.range(n).selectExpr("id AS work_id", "'crossref' AS source_db", "concat(repeat('a title of many words ', 20), id % 7) AS title", "array('Weber, A.') AS authors", "2000 AS year", "'Letters' AS journal", "'' AS doi", "'' AS arxiv")


def test_works_are_not_sent_by_the_size_of_their_file(spark, tmp_path):
    wide_works(spark, 3000).coalesce(1).write.parquet(f"{tmp_path}/works")
    works = spark.read.parquet(f"{tmp_path}/works")
    refs = spark.createDataFrame([("r", "a title", ["Weber, A."], 2000, "Letters", "")], "ref_id string, title string, authors array<string>, year int, journal string, url string")
    pairs = spark.range(3000).selectExpr("'r' AS ref_id", "id AS work_id")
    size = sum(f.stat().st_size for f in (tmp_path / "works").glob("*.parquet"))
    with settings(spark, **{LIMIT: str(2 * size)}):
        scored = linkage.score_pairs(pairs, refs, works)
        assert "work_title" not in "".join(line for line in plan(scored).splitlines() if "BroadcastExchange" in line)
        assert "BroadcastHashJoin [work_id" not in plan(scored) and scored.count() == 3000
    with settings(spark, **{LIMIT: str(64 * size)}):
        assert "BroadcastHashJoin [work_id" in plan(linkage.score_pairs(pairs, refs, works))


@pytest.mark.parametrize("name", ["score_pairs", "judge_pairs"])
def test_no_catalog_is_sent_beside_large_references(spark, sf_dir, name):
    with settings(spark, **{LIMIT: "20000"}):  # the parts' file is smaller, their works are not
        assert "BroadcastHashJoin" not in plan(getattr(curated, name)(spark, sf_dir))


def test_second_tier_reads_each_side_once(spark):
    fields = "ref_id int, work_id int, work_source_db string, title_score double, raw_score double, score double, title_ok boolean, authors_ok boolean, year_ok boolean, venue_ok boolean, id_ok boolean"
    row = lambda ref, work, db, raw: (ref, work, db, 0.9, raw, raw, True, True, True, True, True)
    old = [row(1, 1, "scholar", 0.9), row(1, 2, "base", 0.5), row(2, 3, "scholar", 0.4), row(3, 4, "base", 0.6), row(None, 5, "scholar", 0.7), row(5, 9, None, 0.2)]
    new = [row(1, 6, "scholar", 0.3), row(1, 7, "scholar", 0.6), row(3, 8, "z", 0.6), row(4, 9, "z", 0.1), row(4, 8, "a", 0.1), row(4, 9, "a", 0.1), row(None, 6, "scholar", 0.2), row(5, 4, "scholar", None)]
    out = linkage.second_tier_verdicts(spark.createDataFrame(old, fields), spark.createDataFrame(new, fields))
    assert plan(out).count("Exchange hashpartitioning") == 1
    got = sorted(((r.ref_id, r.work_id, r.source_db) for r in out.collect()), key=str)
    assert got == [(1, 7, "scholar"), (2, 3, "scholar"), (3, 4, "base"), (4, 8, "a"), (5, 9, None), (None, 5, "scholar")]


def test_lattice_deals_a_reference_in_one_row(spark):
    rows = [(1, "a", 1, 3.0, 7, 7), (1, None, 1, 5.0, 1, 7), (1, None, 2, None, 0, 0), (1, "b", 3, 1.0, 4, 4), (1, "b", 3, 1.0, 4, 4), (None, "a", 9, 2.0, 0, 7), (1, None, 4, 5.0, 0, 7), (1, None, 5, 6.0, 0, 7)]
    out = linkage.relaxation_lattice(spark.createDataFrame(rows, "ref_id int, source_db string, work_id int, weight double, keys int, usable int"), 2)
    assert re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan(out))) == ["ref_id, 8"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", 1, 8), (1, "b", 3, 4), (1, None, 1, 2), (1, None, 5, 1), (None, "a", 9, 1)], key=str)


def test_comparison_rows_deals_what_python_made_by_itself(spark):
    side = "ref_id int, title string, authors array<string>, year int, journal string, doi string, parse_confidence double"
    rows = spark.createDataFrame([(1, "Deep maps", ["Weber, A."], 2000, None, None, 0.9), (2, None, None, None, "J", "10.1/A", 0.9), (3, "x", [], 2001, "J", None, None)], side)
    refs = spark.createDataFrame([(1, 5, 1, "a\nb"), (2, 5, 2, None), (3, 5, 3, "c")], "ref_id int, doc_id int, ref_number int, raw string")
    out = compare.comparison_rows(compare.compare_extractions(rows, rows), refs)
    assert "EvalPython" not in plan(out)
    assert sorted((r.source_id, r.title_sim, r.journal_sim, r.ner_authors, r.raw_text) for r in out.collect()) == [(1, 1.0, None, "Weber, A.", "a b"), (2, 0.0, 1.0, None, None)]


def test_entities_of_a_reference_travel_in_one_row(spark):
    raw = "Deep maps 1987 1234-5678 8765-4321"
    refs = spark.createDataFrame([(1, raw), (1, raw), (2, None), (None, raw)], "ref_id int, raw string")
    rows = [(1, "TITLE", 0, 9, 0.9), (1, "ISSN", 15, 24, 0.6), (1, "ISSN", 25, 34, None), (1, "ISSN", 25, 34, 0.7), (1, None, 0, 4, 0.9), (2, "TITLE", 0, 4, 0.9), (None, "TITLE", 0, 9, 0.9), (3, "TITLE", 0, 4, 0.9)]
    out = labels.parsed_from_entities(spark.createDataFrame(rows, "ref_id int, label string, start int, end int, score double"), refs)
    assert re.search(r"partial_collect_list\(struct\(label", plan(out))
    assert sorted((r.ref_id, r.title, r.year, r.issn) for r in out.collect()) == [(1, "Deep maps", 1987, ["1234-5678", "8765-4321"]), (2, None, None, [])]


def test_rows_are_aligned_without_json(spark):
    have = "a string, m struct<x: int, y: string, z: array<struct<p: string, q: int>>>, l array<struct<y: string, u: int>>, k map<string,boolean>, n bigint, t array<int>"
    rows = [("s", (1, "y", [("p", 2), None]), [("y", 1), None, (None, 2)], {"a": True, "b": None}, 5, [1, None]), (None, None, None, None, None, None), ("", (None, None, None), [], {}, -1, [])]
    want = "l array<struct<w: double, y: string>>, m struct<z: array<struct<q: int, p: string, r: int>>, x: int>, k map<string,boolean>, a string, n int, t array<string>, gone map<string,boolean>"
    df = spark.createDataFrame(rows, have)
    by_json = df.select(F.from_json(F.to_json(F.struct("*")), want).alias("_row")).select("_row.*")
    out = aligned(df, want)
    assert out.dtypes == by_json.dtypes and out.collect() == by_json.collect()
    assert "json" not in plan(aligned(df.drop("n", "t"), want)).lower()


def test_what_a_written_step_shuffled_is_gone(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).endswith(".data")}

    before = shuffled()
    made = persisted(spark.range(1000).repartition(3, "id"), "rows")
    assert shuffled() <= before and made.count() == 1000
