import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from bibweave.llm.queries import op9_quality
from bibweave.session import persisted
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import targets
from tests.llm.test_packing import plain


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rejected = {r.doc_id for r in op9_quality(spark, sf_dir).where("predicted = 0").collect()}

    good = persisted(pipeline.quality_filter(spark, docs, sf_dir), "good")
    rows = good.collect()
    assert good.columns == columns
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()} - rejected

    unique = persisted(pipeline.drop_copies(spark, good, sf_dir), "unique")
    first = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(r.doc_id, first.get(key, r.doc_id))
    rows = unique.collect()
    assert unique.columns == columns and sorted(r.doc_id for r in rows) == sorted(first.values())

    single = persisted(pipeline.drop_near_copies(spark, unique, sf_dir), "single")
    kept = [k for k, _, c in brute([(r.doc_id, r.text) for r in rows]) if k == c]
    rows = single.collect()
    assert single.columns == columns and sorted(r.doc_id for r in rows) == sorted(kept)

    mixed = persisted(pipeline.mix_sources(spark, single, sf_dir), "mixed")
    words = lambda r: len((r.text or "").encode().split())
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += words(r)
        largest[r.source] = max(largest[r.source], words(r))
    mixed_rows = mixed.collect()
    for r in mixed_rows:
        taken[r.source] += words(r)
    want = targets(sizes)
    assert mixed.columns == columns and all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert max(Counter(r.doc_id for r in mixed_rows).values()) <= 3

    packed = pipeline.pack(spark, mixed, sf_dir).collect()
    assert sum(r.length for r in packed) == sum(map(len, plain([r.text for r in mixed_rows], 0)))

    whole = pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_mix_weighs_with_the_filters_classifier(spark, sf_dir, monkeypatch):
    """The model of the mix is that of the filter, also on what the filter left."""
    models, fit_on = [], pipeline.quality.fit_on
    monkeypatch.setattr(pipeline.quality, "fit_on", lambda *a, **b: models.append(fit_on(*a, **b)) or models[-1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = persisted(pipeline.quality_filter(spark, docs, sf_dir), "good")
    pipeline.mix_sources(spark, good, sf_dir)
    first, second = models
    texts = [(r.text or "").encode() for r in good.limit(50).collect()]
    assert first.weights.any() and (first.scores(texts) == second.scores(texts)).all()


CLASH = ["_dropped", "mix_copies", "_copy", "_quality_score", "k1", "k2", "c0", "c3", "label", "size", "key", "tie", "node", "id", "n", "kept", "copies", "source_size"]


def test_odd_rows(spark, sf_dir):
    """Repeated and null ids, null, empty and very long texts, repeated rows, extra columns of every helper's name."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [
        (1, " ".join(base), "a"), (3, near, "a"), (3, "an unrelated text that only shares the id of a near copy", "b"), (5, near + " end", None), (None, " ".join(base) + " too", "a"),
        (None, "nobody knows the id of this text at all", "b"), (6, None, "a"), (6, "", "a"), (7, " ", None), (8, "twice the same row in here", "b"), (8, "twice the same row in here", "b"),
        (9, "long " * 30_000, "b"), (4, "twice  the same row\nin here", "b"),
    ]
    docs = spark.createDataFrame([(k, t, "en", s, 0, i) for i, (k, t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, nr int")
    docs = docs.select("*", *[(F.col("nr") * 10 + i).alias(c) for i, c in enumerate(CLASH)])
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    whole = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    line = {r.nr: tuple(r) for r in docs.collect()}
    of = lambda df: Counter(r.nr for r in df.collect())

    good = pipeline.quality_filter(spark, docs, sf_dir)
    assert good.columns == docs.columns and set(of(good).values()) <= {1}

    unique = pipeline.drop_copies(spark, docs, sf_dir)
    got = of(unique)
    # equal texts: 6 and 6 (empty, both id 6: one stays), 8, 8 and 4 (4 stays)
    assert sum(got[i] for i in (6, 7)) == 1 and got[12] == 1 and not got[9] and not got[10]
    assert all(got[i] == 1 for i in (0, 1, 2, 3, 4, 5, 8, 11)) and sum(got.values()) == 10

    single = pipeline.drop_near_copies(spark, docs, sf_dir)
    got = of(single)
    # 1, 3 (near), 5 and the null id are one component: 1 stays; the other text of id 3 stays; rows without words all stay
    assert got[0] == 1 and not got[1] and got[2] == 1 and not got[3] and not got[4]
    assert all(got[i] == 1 for i in (5, 6, 7, 8, 11, 12)) and not got[9] and not got[10] and sum(got.values()) == 8

    mixed = pipeline.mix_sources(spark, docs, sf_dir)
    got = of(mixed)
    assert set(got) <= set(range(13)) - {6, 7, 8} and max(got.values()) <= 3
    for df in (unique, single, mixed):
        assert df.columns == docs.columns and all(r == line[r[5]] for r in map(tuple, df.collect()))

    packed = pipeline.pack(spark, docs, sf_dir).collect()
    assert sum(r.length for r in packed) == sum(map(len, plain([t for _, t, _ in rows], 0)))
    assert whole(good) == sorted((line[i] for i in of(good)), key=repr)
