from bibweave.operators import linkage

REF = "ref_id string, title string, authors array<string>, year int, journal string, url string"
WORK = "work_id long, source_db string, title string, authors array<string>, year int, journal string, doi string, arxiv string"


def found(spark, refs, works):
    rows = linkage.verify(spark.createDataFrame(refs, REF), spark.createDataFrame(works, WORK)).collect()
    return {r.ref_id: r for r in rows}


def work(n, title, authors, year=2000, db="crossref"):
    return (n, db, title, authors, year, "Annals of Testing", f"10.1000/{n}", None)


def test_ties_and_wrong_rare_keys_keep_the_true_work(spark):
    stock = [work(n, "Editorial", [f"Other{n}, Ada"]) for n in range(1, 9)] + [work(9, "Editorial", ["Keller, Boris"])]
    # the misspelt word forms two keys that works of another subject hold; the true title's own keys are more frequent
    true = work(20, "sparse planning for deep river water basin models", ["Novak, Lena"])
    wrong = [work(21, "sparce planning notes", ["Weber, Ines"]), work(22, "market sparce report", ["Weber, Ines"])]
    wrong += [work(30 + n, "rates for sparce market tables in the deep south", ["Weber, Ines"]) for n in range(6)]
    common = [work(50 + n, f"planning for deep river water basin models of area {n}", ["Silva, Hugo"], 1990) for n in range(8)]
    refs = [
        ("stock", "Editorial", ["Keller, Boris"], 2000, "Annals of Testing", ""),
        ("misspelt", "market sparce planning for deep river water basin models", ["Novak, Lena"], 2000, "Annals of Testing", ""),
    ]
    got = found(spark, refs, [*stock, true, *wrong, *common])
    assert (got["stock"].work_id, got["stock"].decision) == (9, "valid")
    assert got["misspelt"].work_id == 20


def test_a_wrong_year_is_searched_again_in_each_database(spark):
    title = "routing of harbour towns"
    other = [work(2, "a long story of harbour lights and other songs", ["Petrov, Karim"]), work(3, "an older tale of harbour people", ["Petrov, Karim"], 2000, "pubmed")]
    refs = [("r", title, ["Okafor, Dana"], 2000, "Annals of Testing", "")]
    for db in ("crossref", "openalex"):
        assert found(spark, refs, [work(1, title, ["Okafor, Dana"], 2006, db), *other])["r"].work_id == 1


def test_a_ruined_title_is_found_by_author_venue_and_year(spark):
    others = [work(n, f"an older study of rivers {n}", ["Novak, Lena"], 1980) for n in range(2, 12)]
    works = [work(1, "sparse planning for deep basins", ["Keller, Ada", "Weber, Ines"], 2001), *others]
    refs = [
        ("ruined", "spxrse plxnnxng fxr dxxp bxsxns", ["Keller, Ada", "Weber, Ines"], 2000, "Annals of Testing", ""),
        ("no title", None, ["Keller, Ada"], 2001, "Annals of Testing", ""),
        ("year alone", "quite another thing", ["Stranger, Q."], 2001, "", ""),
        ("empty", None, None, None, None, None),
    ]
    got = found(spark, refs, works)
    assert {r: got[r].work_id for r in got} == {"ruined": 1, "no title": 1, "year alone": None, "empty": None}
    assert got["ruined"].decision == "citation" and "!year" not in got["ruined"].problem_tags


def test_fields_give_the_first_works_of_each_combination(spark):
    """More works of one combination than a list holds, ties, works and references without fields, and a repeated reference."""
    works = [work(n, f"title {n}", ["Keller, Ada", "Keller, Bo"], 2000 + n % 2, "crossref" if n % 3 else "pubmed") for n in range(1, 40)]
    works += [(100, "crossref", "bare", None, None, None, None, None), (101, None, "b", ["Keller, A."], 2000, "Annals of Testing", None, None)]
    refs = [("a", "x", ["Keller, C."], 2000, "Annals of Testing", ""), ("a", "x", ["Keller, C."], 2000, "Annals of Testing", ""), ("b", None, None, None, None, None), ("c", "x", [], 2000, "Journal", "")]
    rows = linkage.block_by_fields(spark.createDataFrame(refs, REF), spark.createDataFrame(works, WORK)).collect()
    got = {(r.source_db, r.work_id): r.levels for r in rows if r.ref_id == "a"}
    want = {}
    for db in ("crossref", "pubmed", ""):
        held = [w for w in works if (w[1] or "") == db and w[3]]
        for near in (True, True, True, False):  # the level of author and venue doesn't see years
            for w in sorted(held, key=lambda w: (near and abs(w[4] - 2000), w[0]))[:5]:
                want[db, w[0]] = want.get((db, w[0]), 0) + 1
    assert got == want and {r.ref_id for r in rows} == {"a"}


def test_years_one_apart_agree(spark):
    refs = [(f"r{y}", "sparse planning for deep basins", ["Keller, Ada"], y, "Annals of Testing", "") for y in (1998, 1999, 2000, 2001, None)]
    got = found(spark, refs, [work(1, "sparse planning for deep basins", ["Keller, Ada"])])
    assert {r for r in got if "!year" not in got[r].problem_tags} == {"r1999", "r2000", "r2001"}
    assert {r for r in got if got[r].decision == "valid"} == {"r1999", "r2000", "r2001"}


def test_match_by_arxiv_keeps_long_numbers_apart(spark):
    refs = spark.createDataFrame([(1, "https://arxiv.org/abs/2101.110001v1"), (2, "https://arxiv.org/abs/2101.110002v3")], "ref_id long, url string")
    works = spark.createDataFrame([(10, "2101.110001v9"), (20, "2101.110002"), (30, "2101.11000")], "work_id long, arxiv string")
    assert sorted((r.ref_id, r.work_id) for r in linkage.match_by_arxiv(refs, works).collect()) == [(1, 10), (2, 20)]


def test_match_by_arxiv_meets_a_repeated_work_once(spark):
    refs = spark.createDataFrame([(1, "https://arxiv.org/abs/2101.11000v1"), (2, "")], "ref_id long, url string")
    works = spark.createDataFrame([(10, "2101.11000v9"), (10, "2101.11000"), (20, "2101.11000v2"), (30, None)], "work_id long, arxiv string")
    assert sorted((r.ref_id, r.work_id) for r in linkage.match_by_arxiv(refs, works).collect()) == [(1, 10), (1, 20)]


def test_block_by_title_cuts_stock_titles_before_questions_are_told_apart(spark, monkeypatch):
    kept = {}

    def counted(df, name, write=linkage.persisted):
        out = write(df, name)
        kept[name] = max(kept.get(name, 0), out.count())
        return out

    monkeypatch.setattr(linkage, "persisted", counted)
    names = [f"Name{c}" for c in "abcdefgh"]
    rows = [(100 * year + n, "crossref", f"Study {'abcdef'[n % 6]} in the journal", [f"{names[n % 8]}, Q."], 1900 + year, None, None, None) for year in range(12) for n in range(24)]
    works = spark.createDataFrame(rows, WORK)
    refs = spark.createDataFrame([(f"{s}{y}", "invented matters in the journal", [f"{s}, A."], y, None, "") for s in names for y in (1903, 1907)], REF)
    index = linkage.build_catalog_index(works, rare=4)
    got = {(r.ref_id, r.work_id) for r in linkage.block_by_title(refs, index, 2).collect()}
    assert 0 < kept["heads"] <= 16 * 4 * 2  # questions, lists by title and by surname, k
    by_author = {s: [(w[0], w[4]) for w in rows if w[3] == [f"{s}, Q."]] for s in names}
    want = {(f"{s}{y}", i) for s in names for y in (1903, 1907) for near in (False, True) for i in sorted(i for i, at in by_author[s] if not near or abs(at - y) <= 1)[:2]}
    assert got == want
