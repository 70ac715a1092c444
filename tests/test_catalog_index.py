import math
import random
from collections import Counter

import pytest

from bibweave.operators import catalog_index, linkage
from bibweave.streaming import feeds

WORK = "work_id long, source_db string, title string, authors array<string>, year int"
REF = "ref_id string, title string, authors array<string>, year int"
WORDS, NAMES, YEARS = "alpha beta gamma delta eps zeta eta theta".split(), ["Keller", "Novak", "Weber", "Silva"], [None, 2000, 2001, 2002, 2005]


def made(n_works, n_refs, seed):
    rng = random.Random(seed)
    title = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(0, 7)))
    works = [(i, rng.choice("abc"), title(), [rng.choice(NAMES) + ", A."] * rng.randrange(0, 3), rng.choice(YEARS)) for i in range(n_works)]
    return works, [(f"r{i}", title(), [rng.choice(NAMES) + ", B."][: rng.randrange(0, 2)], rng.choice(YEARS)) for i in range(n_refs)]


def keys(title):
    w = title.lower().split()
    return set(w) if len(w) < 2 else {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}


def brute(works, refs, k=5):
    """Every work that shares a key is ranked, for each reference and database."""
    idf = {t: round(math.log1p(len(works) / n) * 1e6) for t, n in Counter(t for w in works for t in keys(w[2])).items()}
    out = set()
    for ref, title, authors, year in refs:
        name = authors[0].split(",")[0].lower() if authors else None
        for db in {w[1] for w in works}:
            met = [w for w in works if w[1] == db and keys(title) & keys(w[2])]
            ranked = sorted((-sum(idf[t] for t in keys(title) & keys(w[2])), not any(a.split(",")[0].lower() == name for a in w[3]), len(keys(w[2])), w[0], w[4]) for w in met)
            near = [r for r in ranked if None not in (year, r[4]) and abs(r[4] - year) <= 1]
            out |= {(ref, db, r[3], -r[0]) for r in ranked[:k] + near[:k]}
    return out


def pairs(frame):
    return {(r.ref_id, r.source_db, r.work_id, round(r.weight * 1e6)) for r in frame.collect()}


@pytest.mark.parametrize("rare, rounds", [(0, (1, 3)), (8, ()), (1000, (3,))])
def test_all_works_compete(spark, rare, rounds):
    """All keys frequent, some, none; null years, no authors, empty and equal titles."""
    works, refs = made(400, 60, 5)
    index = catalog_index.build_catalog_index(spark.createDataFrame(works, WORK), rare=rare)
    assert pairs(linkage.block_by_title(spark.createDataFrame(refs, REF), index, rounds=rounds)) == brute(works, refs)


def test_each_database_has_its_own_list(spark):
    """One good hit in one database doesn't close the others."""
    works = [(1, "a", "common words here of rare birds", ["Keller, A."], 2000), (2, "b", "common words here", [], 2000), *[(10 + i, "c", "common words here", [], 2000) for i in range(30)]]
    refs = [("r", "common words here of rare birds", ["Keller, A."], 2000)]
    for rare in (0, 64):
        got = pairs(linkage.block_by_title(spark.createDataFrame(refs, REF), catalog_index.build_catalog_index(spark.createDataFrame(works, WORK), rare=rare)))
        assert got == brute(works, refs) and Counter(db for _, db, _, _ in got) == {"a": 1, "b": 1, "c": 5}


def test_stock_words_meet_classes_not_works(spark):
    """Works that share frequent words only are few classes, however many they are."""
    works = [(i, "ab"[i % 2], "notes in the journal of applied studies", [f"{NAMES[i % 4]}, A."], 2000 + i % 3) for i in range(2000)]
    index = catalog_index.build_catalog_index(spark.createDataFrame(works, WORK))
    assert index.table("class_terms").select("cls").distinct().count() == 6 and index.table("postings").count() == 0
    refs = [(f"r{i}", f"invented {i} in the journal of applied studies", ["Weber, B."], 2001) for i in range(20)]
    assert pairs(linkage.block_by_title(spark.createDataFrame(refs, REF), index)) == brute(works, refs)


def test_appends_equal_one_build_and_a_dead_append_is_not_seen(spark, tmp_path):
    works, refs = made(300, 40, 7)
    all_works, asked = spark.createDataFrame(works, WORK), spark.createDataFrame(refs, REF)
    index = catalog_index.build_catalog_index(all_works.where("work_id < 200"), str(tmp_path / "index"), rare=8)
    grown = catalog_index.append_works(index, all_works.where("work_id >= 150"))
    assert pairs(linkage.block_by_title(asked, grown)) == brute(works, refs)
    assert pairs(linkage.block_by_title(asked, index)) == brute(works[:200], refs)  # the version before stays whole
    assert catalog_index.open_catalog_index(spark, index.folder) == grown
    all_works.write.parquet(str(tmp_path / "index" / "works" / "2"))  # an append that died half-way
    again = catalog_index.open_catalog_index(spark, index.folder)
    assert again == grown and again.works.count() == 300


def test_micro_batches_read_no_catalog_and_see_appends(spark, tmp_path, monkeypatch):
    schema = REF + ", journal string, url string"
    works = [(1, "a", "routing of harbour towns", ["Okafor, D."], 2000), (2, "a", "sparse planning for deep rivers", ["Novak, L."], 2001)]
    refs = [("r1", "routing of harbour towns", ["Okafor, D."], 2000, "", ""), ("r2", "latent models of slow markets", ["Silva, H."], 1999, "", "")]
    index = catalog_index.build_catalog_index(spark.createDataFrame(works, WORK))
    monkeypatch.setattr(linkage, "build_catalog_index", None)
    monkeypatch.setattr(feeds, "build_catalog_index", None)
    seen = []

    def sink(rows, epoch):
        seen.append({r.ref_id: r.work_id for r in rows.collect()})

    for i in range(2):
        spark.createDataFrame(refs, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "refs"))
        feeds.verify_stream(feeds.read_feed(spark, str(tmp_path / "refs"), spark.createDataFrame(refs, schema).schema), index, sink, str(tmp_path / "state")).awaitTermination()
        catalog_index.append_works(index, spark.createDataFrame([(3, "a", "latent models of slow markets", ["Silva, H."], 1999)], WORK))
    assert seen == [{"r1": 1, "r2": None}, {"r1": 1, "r2": 3}]
