"""Rows of one reference travel together: how often the larger steps deal their rows, and what they give on odd inputs."""

from bibweave.operators import compare, curation, firsts, labels, linkage
from bibweave.sources import store


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bio_tags_reads_its_tokens_once(spark):
    texts = spark.createDataFrame([(1, "deep learning for maps"), (2, "no spans"), (3, "")], "k int, t string")
    spans = spark.createDataFrame([(1, 0, 13, "TITLE"), (1, 0, 13, "TITLE"), (1, 5, 17, "JOURNAL"), (1, 18, 22, "NOPE"), (9, 0, 4, "DOI")], "k int, start int, end int, label string")
    out = labels.bio_tags(labels.word_tokens(texts, "k", "t"), spans, "k")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 0, "B-TITLE"), (1, 1, "B-JOURNAL"), (1, 2, "I-JOURNAL"), (1, 3, "O"), (2, 0, "O"), (2, 1, "O")]


def test_lattice_deals_candidates_once(spark):
    rows = [(1, "a", w, float(weight), keys, 7) for w, weight, keys in ((1, 3, 7), (2, 5, 1), (3, 5, 1), (4, 1, 6))] + [(1, "a", 5, None, 1, 7), (1, "b", 6, 1.0, 0, 0)]
    out = linkage.relaxation_lattice(spark.createDataFrame(rows, "ref_id int, source_db string, work_id int, weight double, keys int, usable int"), 2)
    assert exchanges(out) == 1
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1, 6), (1, "a", 2, 2), (1, "a", 3, 2), (1, "a", 4, 3), (1, "b", 6, 1)]


def test_best_matches_deal_once(spark):
    rows = [(1, "a", 7, 0.9, 0.9), (1, "a", 8, 1.3, 1.0), (1, "b", 9, 1.4, 1.0), (1, "b", 2, 1.0, 1.0), (2, "a", 1, 0.0, 0.0)]
    per = linkage.best_per_database(spark.createDataFrame(rows, "ref_id int, work_source_db string, work_id int, raw_score double, score double"))
    best = linkage.best_match(per)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.ref_id, r.work_source_db, r.work_id) for r in per.collect()) == [(1, "a", 8), (1, "b", 2)]
    assert [(r.ref_id, r.work_id) for r in best.collect()] == [(1, 8)]


def test_second_tier_merge_deals_once(spark):
    old = spark.createDataFrame([(1, "scholar", "old", 0.9), (1, "base", "b", 0.5), (2, "scholar", "kept", 0.4)], "ref_id int, source_db string, title string, raw_score double")
    new = spark.createDataFrame([("x", 1, 0.3, "scholar"), ("y", 1, 0.6, "scholar"), ("z", 3, 0.1, "scholar")], "title string, ref_id int, raw_score double, source_db string")
    out = curation.merge_second_tier(old, new)
    assert exchanges(out) == 1
    assert sorted(map(tuple, out.collect())) == [(1, "base", "b", 0.5, 2), (1, "scholar", "y", 0.6, 1), (2, "scholar", "kept", 0.4, 1), (3, "scholar", "z", 0.1, 1)]


def test_pairs_meet_unprepared_sides(spark):
    refs = spark.createDataFrame([(1, "Deep maps of things", ["Keller, A."], 2000, "J. Appl. Res.", "")], "ref_id int, title string, authors array<string>, year int, journal string, url string")
    works = spark.createDataFrame([(5, "a", "Deep maps of things", ["Keller, Ada"], 2000, "Journal of Applied Research", "", None)], "work_id int, source_db string, title string, authors array<string>, year int, journal string, doi string, arxiv string")
    pairs = spark.createDataFrame([(1, 5)], "ref_id int, work_id int")
    early = linkage.score_pairs(pairs, linkage.prepared(refs), linkage.prepared(works)).collect()
    assert linkage.score_pairs(pairs, refs, works).collect() == early and early[0].title_score == 1.0


def test_annotations_go_to_python_in_batches(spark):
    refs = spark.createDataFrame([(1, "deep x and deep"), (2, None)], "ref_id int, raw string")
    asked = [(1, 1, "deep", "TITLE"), (1, 0, " x ", "DOI"), (1, 2, "deep", "TITLE"), (1, 3, "deep", "TITLE"), (1, 4, " ", "DOI"), (2, 0, "a", "DOI"), (2, 1, "a", "NOPE")]
    out = labels.locate_annotations(refs, spark.createDataFrame(asked, "ref_id int, at int, substring string, label string"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.ref_id, r.at, r.start, r.end, r.error) for r in out.collect())
    assert got == [(1, 0, 5, 6, None), (1, 1, 0, 4, None), (1, 2, 11, 15, None), (1, 3, None, None, "not found"), (1, 4, None, None, "empty"), (2, 0, None, None, "not found"), (2, 1, None, None, "unknown label")]


def test_levels_are_walked_once(spark):
    json = '{"list": [{"x": {"text": "a text that is long enough"}}, 7, "raw_text"], "text": 12345678901234567890123, "deep": {"raw_text": "short", "text": "another text of some length", "in": {"text": "never searched as it lies inside"}}}'
    out = store.walk_reference_records(spark.createDataFrame([(1, json), (2, "no json"), (3, "[]")], "k int, j string"), "k", "j")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # every level is read from where it was written
    assert sorted((r.key, r.path, r.text) for r in out.collect()) == [(1, "$.deep", "another text of some length"), (1, "$.list[0].x", "a text that is long enough")]


def test_entities_run_the_patterns_of_their_label_only(spark):
    refs = spark.createDataFrame([(1, "Deep maps. 1999. doi:10.5555/abc")], "ref_id int, raw string")
    entities = spark.createDataFrame([(1, "TITLE", 0, 9, 0.9), (1, "PUBLICATION_YEAR", 11, 13, 0.9), (1, "DOI", 21, 32, 0.9)], "ref_id int, label string, start int, end int, score double")
    out = labels.parsed_from_entities(entities, refs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f" = {label}) THEN") > 0 for label in ("DOI", "PUBLICATION_YEAR")] == [True, True]
    assert out.select("title", "year", "doi").first() == ("Deep maps", 1999, "10.5555/abc")


def test_search_by_fields_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(linkage, "build_catalog_index", lambda *_, **__: 1 / 0)
    refs = spark.createDataFrame([(1, ["Keller, A."], 2000, "Annals of Deep Maps")], "ref_id int, authors array<string>, year int, journal string")
    works = spark.createDataFrame([(w, None, "t", ["Keller, Ada"], 2000 + w, "Annals of Deep Maps") for w in (3, 1, 0)], "work_id int, source_db string, title string, authors array<string>, year int, journal string")
    out = linkage.block_by_fields(refs, works, 2)
    assert sorted(map(tuple, out.collect())) == [(1, "", 0, 4), (1, "", 1, 4)]


def test_equal_texts_are_compared_without_python(spark):
    schema = "ref_id int, title string, authors array<string>, year int, journal string, doi string, parse_confidence double"
    a = [(1, "Deep maps", ["Keller, A."], 1, "J. Maps, vol. 3", None, 1.0), (2, "ﬁne  Ｍaps!", ["Ünal, Ö."], 1, None, None, 1.0), (3, None, None, None, "A", "", 1.0), (4, "a b c", [], 1, "--", "x", 1.0)]
    b = [(1, "DEEP: maps", ["Ada Keller"], 1, "j maps", None, 1.0), (2, "fine maps", ["Ö. ÜNAL"], 1, "", None, 1.0), (3, " ", [], None, "b", None, 1.0), (4, "c d", ["X"], 2, "!", "X", 1.0)]
    sent = []
    real = compare.token_set_ratio
    compare.token_set_ratio = lambda x, y: sent.append((x, y)) or real(x, y)
    try:
        out = compare.compare_extractions(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    finally:
        compare.token_set_ratio = real
    assert len(sent) == 2 and all("CASE WHEN" in str(c) for pair in sent for c in pair)  # null where the sides are equal
    got = {r.ref_id: (r.title_score, r.journal_score, r.authors_jaccard, r.year_match, r.doi_match) for r in out.collect()}
    assert got[1] == (1.0, 1.0, 1.0, True, True) and got[2] == (1.0, None, 1.0, True, True) and got[3] == (0.0, 0.0, 1.0, True, True)
    assert 0 < got[4][0] < 1 and got[4][1:] == (0.0, 0.0, False, True)


def test_entity_kinds_need_no_pattern(spark):
    rows = [(1, i, label, i, i + 1, 0.5) for i, label in enumerate(["B-A", "I-A", "B-A", "O", "I-B", "B", "X-A", "I-A"])] + [(2, 0, None, 0, 1, 1.0)]
    out = labels.entities_from_bio(spark.createDataFrame(rows, "ref_id int, tok int, label string, start int, end int, score double"))
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.label, r.start, r.end) for r in out.collect()) == [("A", 0, 2), ("A", 2, 3), ("A", 7, 8), ("B", 4, 6), ("X-A", 6, 7)]


def dealt_unsorted(df):
    """Whether rows are dealt once, by ref_id alone, and nothing is sorted before that."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    before = plan.partition("Exchange hashpartitioning(ref_id#")[2]
    return exchanges(df) == 1 and "Sort" in plan and before != "" and "Sort" not in before


def in_batches_of(spark, n, df):
    """The rows of df where Arrow batches hold n rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        return sorted(map(tuple, df.collect()), key=repr)
    finally:
        spark.conf.set(name, old)


def test_words_are_dealt_without_a_sort(spark):
    rows = [(1, 0, None, "X"), (1, 2, 0, "B"), (1, 1, 0, "A"), (1, 3, 1, None), (2, 5, 0, "C"), (1, 4, 1, "E"), (None, 2, 0, "F"), (2, None, 0, "G"), (2, None, 7, "H"), (None, 1, 0, "I"), (2, 4, 0, "J"), (1, 0, 0, "K")]
    out = labels.word_level_predictions(spark.createDataFrame(rows, "ref_id int, piece int, word int, label string").coalesce(1))
    assert dealt_unsorted(out)
    want = sorted([(1, 0, "K"), (1, 1, None), (2, 0, "J"), (2, 7, None), (None, 0, "I")], key=repr)
    assert all(in_batches_of(spark, n, out) == want for n in (1, 3, 5, 10_000))


def test_later_rows_of_a_batch_stay_home(spark):
    rows = spark.range(3000).selectExpr("id div 6 AS ref_id", "CAST(id % 6 AS INT) AS piece", "CAST(id % 6 div 2 AS INT) AS word", "'L' AS label").coalesce(1)
    left = firsts.without_later(rows, ["ref_id", "word"], {"piece": "ascending"})
    assert in_batches_of(spark, 600, left) == sorted(((r, p, p // 2, "L") for r in range(500) for p in (0, 2, 4)), key=repr)


def test_enrichment_deals_best_rows_without_a_sort(spark):
    nan = float("nan")
    rows = [(1, 2, 0.5, True, "b"), (1, 1, 0.5, True, "a"), (1, 0, 0.1, True, "z"), (2, 0, 0.9, False, "no"), (2, 1, 0.8, True, "c"), (3, 0, 0.9, True, ""), (3, 1, 0.1, True, "d"), (4, 0, None, True, "e"), (4, 1, -1.0, True, "f")]
    rows += [(5, 0, 9.0, True, "g"), (5, 3, nan, True, "i"), (5, 2, nan, True, "h"), (6, 0, None, True, "j"), (6, None, None, True, "k"), (7, None, 1.0, True, "l"), (7, 5, 1.0, True, "m"), (None, 0, 0.0, True, "n"), (1, 3, 0.2, True, "y")]
    out = curation.pick_enrichment(spark.createDataFrame(rows, "ref_id int, at int, overlap double, scraped_truncated boolean, cid string").coalesce(1))
    assert dealt_unsorted(out)
    want = sorted([(1, "a"), (4, "f"), (5, "h"), (6, "j"), (7, "m"), (None, "n")], key=repr)
    assert all(in_batches_of(spark, n, out) == want for n in (1, 2, 5, 10_000))
