"""Golden rows of the similarity, name and identifier functions."""

import itertools
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibweave.functions import fuzzy, identifiers, names, text


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcde ", max_size=90), st.text("abcde ", max_size=90))
def test_bit_parallel_lcs_equals_the_table(a, b):
    assert fuzzy.lcs_length(a, b) == lcs(a, b)
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_venues(spark):
    a, b = "African Journal of Biotechnology", "World Journal of Microbiology and Biotechnology"
    pair = {"a": a.lower(), "b": b.lower()}
    assert one(spark, fuzzy.token_sort_ratio(F.col("a"), F.col("b")), **pair) == pytest.approx(0.6835, abs=1e-4)
    assert one(spark, fuzzy.token_set_ratio("a", "b"), **pair) == pytest.approx(0.8571, abs=1e-4)
    similar = fuzzy.venue_similarity(F.col("a"), F.col("b"))
    assert one(spark, similar, a="JMLR", b="Journal of Machine Learning Research") == 1
    assert one(spark, similar, a="J. Appl. Phys.", b="Journal of Applied Physics") > 0.75
    assert one(spark, similar, a=" ", b="x") == 0 and one(spark, similar, a=a, b=b) < 0.75


@pytest.mark.parametrize(
    ("raw", "last", "initials"),
    [
        ("Smith, John", "smith", ["j"]), ("K. Y. Lee", "lee", ["k", "y"]), ("Smith JA", "smith", ["j", "a"]), ("Poehlman J.M.", "poehlman", ["j", "m"]), ("KJ Räihä", "raiha", ["k", "j"]),
        ("Johan Van Der Berg", "van der berg", ["j"]), ("Öztürk Ş", "ozturk", ["s"]), ("Madonna", "madonna", []), ("", "", []), ("G. Liu", "liu", ["g"]), ("JH Lee - Cells", "lee", ["j", "h"]),
    ],
)
def test_split_name(raw, last, initials):
    got = names.split_name(raw)
    assert (got["last"], got["initials"]) == (last, initials)


def test_plain_names():
    assert [names.plain_name(x) for x in ("Müller", "Yılmaz", "Łukasz", "İstanbul", "Ş. Yılmaz")] == ["muller", "yilmaz", "lukasz", "istanbul", "s yilmaz"]


MATCH = [
    (["Smith JA"], ["John Anthony Smith"], True), (["G. Bo-Cai"], ["Gao, Bo-cai"], True), (["F. Akalin"], ["Fatma Akalm"], True),
    (["Goel, A.", "Agarwal, N."], ["Mansi Goel", "Ayush Agarwal", "Rishabh Gupta"], True), ([], ["anyone"], True), (["Smith, J."], ["Smith, K."], False), (["Smith, J"], ["Jones, J"], False),
    (["Smith, J.", "Jones, K."], ["Smith, John", "Totally Different"], False), (["Smith, J."], [], False),
]


def test_author_lists(spark):
    score = [([], [], 0.0), (["Smith, J.", "Jones, K."], ["John Smith", "Unrelated"], 0.5)]
    rows = [(str(i), a, b) for i, (a, b, _) in enumerate(itertools.chain(MATCH, score))]
    got = {int(r.pair_id): r for r in spark.createDataFrame(rows, "pair_id string, a array<string>, b array<string>").select("pair_id", names.author_agreement("a", "b").alias("r")).select("pair_id", "r.*").collect()}
    assert [got[i].match for i in range(len(MATCH))] == [m for _, _, m in MATCH]
    assert [got[len(MATCH) + i].score for i in range(2)] == [s for _, _, s in score]


def one_person(a, b):
    """Surname shared, and one person possible, by the rule for two names."""
    (last, initials, given), (other, initials2, given2) = names.parsed_name(a), names.parsed_name(b)
    alike, same = names.surnames_alike(last, other)
    both, shared = bool(initials) and bool(initials2), bool(initials & initials2)
    if same:
        return True, shared or not both
    inside = (given2 and set(last.split()) <= set(given2.split())) or (given and set(other.split()) <= set(given.split()))
    return False, bool(inside or (both and shared and (alike >= 0.78 or (min(len(last), len(other)) >= 5 and last[:4] == other[:4]))))


def brute_agreement(left, right):
    if not left:
        return {"score": 0.0, "match": True}
    a, b = ([x for x in side or [] if x and names.parsed_name(x)[0]] for side in (left, right))
    if not a or not b:
        return {"score": 0.0, "match": False}
    met = [[one_person(x, y) for y in b] for x in a]
    rows = met if len(a) <= len(b) else list(zip(*met, strict=True))
    lasts, persons = (sum(any(m[i] for m in row) for row in rows) for i in (0, 1))
    hits = lasts if lasts >= 2 else persons
    return {"score": sum(any(m[1] for m in row) for row in met) / len(a), "match": hits == len(rows) if len(rows) <= 2 else hits / len(rows) >= 0.5}


SURNAMES = st.sampled_from(["Smith", "Smyth", "Smithe", "van der Berg", "Berg", "Bergman", "Bergmann", "Li", "Lee", "Garcia Lopez", "Lopez Garcia", "Akalin", "Akalm", "Öztürk", "O'Neil", "Gao", "Bo"])
NAMES = st.one_of(
    st.sampled_from([None, "", " ", "...", "Ω", "K. Y. Lee", "Bo-Cai Gao", "G. Bo-Cai", "John Berg Smith"]),
    st.builds(lambda s, g: f"{s}, {g}", SURNAMES, st.sampled_from(["J.", "J. A.", "John", "Anna Maria", "K", "Berg", ""])), st.builds(lambda g, s: f"{g} {s}", st.sampled_from(["A", "John", "Lopez", "J. R."]), SURNAMES),
    st.text("abcde ,.", max_size=12),
)
LISTS = st.one_of(st.none(), st.lists(NAMES, max_size=6))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(LISTS, LISTS), max_size=8), st.sampled_from([1, 7, names.STEP]))
def test_filtered_lists_agree_as_every_pair_does(rows, step):
    sides = [pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in (0, 1)]
    whole, names.STEP = names.STEP, step
    try:
        assert names.list_agreements(*sides).to_pylist() == [brute_agreement(*r) for r in rows]
        assert names.list_agreements(*[s.slice(1) for s in sides]).to_pylist() == [brute_agreement(*r) for r in rows[1:]]
    finally:
        names.STEP = whole


def test_author_lists_of_thousands():
    syllables = ["ka", "lo", "mi", "ner", "sta", "vu", "re", "tan", "go", "bel", "fi", "dor", "hu", "jes", "wy"]
    left = [f"{a}{b}{c}, {chr(65 + i % 26)}.".title() for i, (a, b, c) in enumerate(itertools.product(syllables, repeat=3))][:3000]
    right = [x.replace("k", "q") for x in reversed(left)]
    began = time.time()
    (got,) = names.list_agreements(*[pa.array([x], pa.list_(pa.string())) for x in (left, right)]).to_pylist()
    assert got["match"] and got["score"] > 0.8 and time.time() - began < 60


def test_identifiers(spark):
    doi = identifiers.extract_doi(F.col("a"))
    assert one(spark, identifiers.normalize_doi(F.col("a")), a="https://doi.org/10.1234/Foo.Bar  ") == "10.1234/foo.bar"
    assert one(spark, doi, a="x. doi: 10.1234/abc- def. Foo") == "10.1234/abc-def"
    assert one(spark, doi, a="see https://dx.doi.org/10.5555/Ab.1). And") == "10.5555/ab.1" and one(spark, doi, a="none") is None
    assert one(spark, identifiers.arxiv_base(identifiers.extract_arxiv(F.col("a"))), a="arXiv:2403. 12345v2") == "2403.12345"
    assert one(spark, identifiers.arxiv_base(identifiers.extract_arxiv(F.col("a"))), a="https://arxiv.org/abs/2101.1234567v2") == "2101.1234567"
    safe = text.url_is_safe(F.col("a"))
    assert [one(spark, safe, a=u) for u in ("http://a.b/", "ftp://a.b/", "http://10.0.0.1/", "https://8.8.8.8:8443/x", "http://a.b:22/", "http://172.20.1.1")] == [True, False, False, True, False, False]


def test_scholar_authors(spark):
    got = spark.range(1).select(names.clean_scholar_authors(F.array(F.lit("JH Lee - Cells"), F.lit("2024"), F.lit("S Niknazar… - Journal of Lasers in…"), F.lit("12"))).alias("x")).first()["x"]
    assert got == ["JH Lee", "S Niknazar"]


def test_functions_in_sql(spark):
    from bibweave.functions.sql import register_functions

    assert {"bib_tokens", "bib_author_agreement"} <= set(register_functions(spark))
    got = spark.sql("SELECT bib_indel_ratio('abc', 'abd') AS r, bib_nfkc('ﬁ') AS c, bib_normalize_name('Ş. Yılmaz') AS n, bib_author_agreement(array('Smith, J.'), array('John Smith')).match AS m").first()
    assert (round(got.r, 4), got.c, got.n, got.m) == (0.6667, "fi", "s yilmaz", True)
    rows = spark.sql("SELECT k, tok, token, start, `end` FROM VALUES ('a', 'x, é!'), ('b', ''), ('c', NULL) AS d(k, v), LATERAL bib_tokens(v)").collect()
    assert sorted(map(tuple, rows)) == [("a", 0, "x", 0, 1), ("a", 1, ",", 1, 2), ("a", 2, "é", 3, 4), ("a", 3, "!", 4, 5)]
