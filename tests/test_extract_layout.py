"""Style detection against a plain re-statement, extraction and segmentation on golden rows."""

import re

import pytest

from pyspark.sql import functions as F

from bibweave.operators import extract, layout
from bibweave.plans import queries

GOLD = [
    ("[12] Smith, J. A., & Jones, K. (2020). Deep learning for citations. Journal of Tests, 12(3), 1-9. https://doi.org/10.1234/abc.5", "Deep learning for citations", "Journal of Tests", 2020, ["Smith, J. A.", "Jones, K."], "10.1234/abc.5"),
    ('3. G. Liu and K. Y. Lee, "A study of things," IEEE Transactions on Tests, vol. 3, no. 2, pp. 1-9, 2019.', "A study of things", "IEEE Transactions on Tests", 2019, ["G. Liu", "K. Y. Lee"], None),
    ("Shingjergji K, Iren D. Facial expressions in learning. Front Psychol. 2021;12:1-9. doi: 10.3389/x.2021", "Facial expressions in learning", "Front Psychol", 2021, ["Shingjergji K", "Iren D"], "10.3389/x.2021"),
    ('Walker, Anna, and Paul Reed. "Reading the margins of maps." Journal of Maps 5 (2012): 33-40.', "Reading the margins of maps", "Journal of Maps", 2012, ["Walker, Anna", "Paul Reed"], None),
]


def test_parse_references(spark):
    rows = [(str(i), g[0]) for i, g in enumerate(GOLD)] + [("x", None), ("y", "short")]
    got = {r.ref_id: r for r in extract.parse_references(spark.createDataFrame(rows, "ref_id string, raw string")).collect()}
    for i, (_, title, journal, year, authors, doi) in enumerate(GOLD):
        r = got[str(i)]
        assert (r.title, r.year, r.authors, r.doi) == (title, year, authors, doi)
        assert r.journal.startswith(journal)
        assert r.parse_confidence >= 0.6
    assert got["x"].parse_confidence == 0 and got["x"].style is None and got["y"].style is None


#: Strings with the style and confidence that follow from the signals, added up by hand.
STYLED = [
    (GOLD[0][0], "APA", 0.31),  # dotted bracket year 2, no quotes, initials and ampersand: 5 points, Harvard 3
    (GOLD[1][0], "IEEE", 0.67),  # quotes 2, late plain year 3, comma at the quote 2, vol. 1: 8 points, Chicago 4
    (GOLD[2][0], "Vancouver", 0.5),  # no quotes, bare surname with initials 3, undotted initials 2: 6 points, IEEE 3
    (GOLD[3][0], "Chicago", 0.58),  # quotes 2, late bracketed year 2, and 2, full names 1: 7 points, MLA 4
    ("Brown, P. 2015. The tides of small harbours. Coastal Studies, 4, 12-30.", "Harvard", 0.31),  # plain year 2, initials, no quotes, early: 5 points, APA 3
    ('Stone, Ruth, et al. "On the meaning of doors." Journal of Houses 3 (2011): 4.', "MLA", 0.21),  # quotes 2, late bracketed year 2, et al.: 5 points, Chicago 4
    ("Brown, P. & Green, Q. A title without any date in it", "APA", 0.12),  # a tie of three points with Harvard: the first of STYLES
    ("plain words here and nothing else at all", None, 0.0),  # one point
    ("(2020). A.", None, 0.0),  # too short
    (None, None, 0.0),
]


def test_styles(spark):
    rows = spark.createDataFrame([(str(i), s[0]) for i, s in enumerate(STYLED)], "ref_id string, raw string")
    got = {int(r.ref_id): (r.style, r.style_confidence) for r in extract.detect_style(rows).collect()}
    assert got == {i: (style, confidence) for i, (_, style, confidence) in enumerate(STYLED)}


def test_segments(spark, sf_dir):
    got = {(r.doc_id, r.ref_no): r for r in queries.segment_references(spark, sf_dir).collect()}
    lines = {(r.doc_id, r.line_no): r for r in queries.printed_lines(spark, sf_dir).collect()}
    docs = {d for d, _ in lines}
    valid = {d for d in docs if d % 3}  # numbered as printed
    numbered = 0
    for d in docs & valid:
        n = sum(k == d for k, _ in lines) // 3
        for i in range(1, n + 1):
            a, b = lines[d, 3 * i - 2].text, lines[d, 3 * i - 1].text
            want = a[:-1] + b.strip() if re.search(r"[a-z]-$", a) and re.match(r"[a-z]", b.strip()) else f"{a} {b}"
            assert re.sub(r"\s+", " ", got[d, i].raw) == re.sub(r"\s+", " ", want).strip()
            numbered += 1
    assert numbered > 100 and {d for d, _ in got} == docs


def test_no_document_loses_its_references(spark):
    def printed(doc, texts):
        header = [(doc, 1, 0, "References", 50.0, 0.0, 100.0, 10.0)]
        return header + [(doc, 1, i, t, 50.0, 30.0 * i, 200.0, 30.0 * i + (28 if i % 2 else 10)) for i, t in enumerate(texts, 1)]

    title = "A study of things that is long enough to stand alone"
    late = printed("late", [f"[{n}] {title}" for n in range(11, 16)])
    noisy = printed("noisy", [f"{n}. {title}" for n in (1, 9, 8, 7, 6, 5, 4, 3, 2, 2, *range(2, 30))])
    one = printed("one", [f"[1] {title}"])
    rows = late + noisy + one
    got = layout.segment_references(spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, {})[r.ref_no] = r.raw
    assert all(f"[{n}] {title}" in " ".join(found["late"].values()) for n in range(11, 16))
    # the numbers that follow on start references, whatever the lines between are
    assert len(found["noisy"]) > 20 and found["noisy"][29] == f"29. {title}"
    assert found["one"] == {1: f"[1] {title}"}


def test_lines_and_boxes(spark):
    items = [("d", 1, 0, "Deep", 0.0, 100.0, 20.0, 10.0), ("d", 1, 1, "learning", 24.0, 100.0, 40.0, 10.0), ("d", 1, 2, "s", 64.0, 100.0, 5.0, 10.0), ("d", 1, 3, "next", 0.0, 80.0, 20.0, 10.0)]
    got = layout.group_items_into_lines(spark.createDataFrame(items, "doc_id string, page int, item int, text string, x double, y double, width double, height double")).collect()
    assert sorted(r.text for r in got) == ["Deep learnings", "next"]
    boxes = spark.createDataFrame([("b", "d", 1, 0.0, 0.0, 50.0, 20.0)], "box_id string, doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([("d", 1, "in", 5.0, 5.0, 9.0, 9.0), ("d", 1, "side", 10.0, 5.0, 20.0, 9.0), ("d", 1, "out", 60.0, 5.0, 70.0, 9.0)], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert layout.text_in_box(words, boxes).first().text == "in side"
    rows = [("d", 1, "two", 20.0, 4.6, 30.0, 8.6), ("d", 1, "one", 5.0, 5.0, 9.0, 9.0), ("d", 1, "next", 5.0, 8.7, 9.0, 12.7), ("d", 1, "edge", 52.0, 5.0, 60.0, 9.0)]
    assert layout.text_in_box(spark.createDataFrame(rows, words.schema), boxes).first().text == "one two next"
    refs = spark.createDataFrame([("d", "a", 1, 0.0, 0.0, 10.0, 10.0), ("d", "b", 1, 0.0, 20.0, 10.0, 30.0), ("d", "c", 2, 0.0, 0.0, 10.0, 10.0)], "doc_id string, ref_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r.ref_id: r.nearest for r in layout.nearest_reference(refs).collect()} == {"a": "b", "b": "a", "c": "a"}


PLAIN = {
    "Keller, A. and Weber, B., 2004. Networks of things. Journal of Graphs, 3(2), pp.1-9.": (["Keller, A.", "Weber, B."], 2004, "Networks of things", "Journal of Graphs"),
    "Keller, A., Weber, B. 2004. Networks of things. Journal of Graphs 3, pp. 1950-1960.": (["Keller, A.", "Weber, B."], 2004, "Networks of things", "Journal of Graphs"),
    "Keller A, Weber B. A title about networks. Journal of Graphs. 2003;12:1990-1999.": (["Keller A", "Weber B"], 2003, "A title about networks", "Journal of Graphs"),
    "Keller A, Weber B, et al. On the year 1999 in networks. Graphs. 2003;12(4):10-9.": (["Keller A", "Weber B"], 2003, "On the year 1999 in networks", "Graphs"),
    'Keller, Ada, and Boris Weber. "Networks of things." Journal of Applied Things 12, no. 3 2005: 1990-1999.': (["Keller, Ada", "Boris Weber"], 2005, "Networks of things", "Journal of Applied Things"),
    'Keller, Ada, and Boris Weber. 2004. "Networks of things." Journal of Graphs 12, no. 3: 1990-1999.': (["Keller, Ada", "Boris Weber"], 2004, "Networks of things", "Journal of Graphs"),
    'A. Keller and B. Weber, "Networks of things," Journal of Graphs, vol. 3, no. 2, pp. 1–9, May 2004.': (["A. Keller", "B. Weber"], 2004, "Networks of things", "Journal of Graphs"),
    "van der Berg, A.-B., & O'Neil, C. (2004, May 3). Networks of things: A study. Journal of Graphs, 3(2), 1-9.": (["van der Berg, A.-B.", "O'Neil, C."], 2004, "Networks of things: A study", "Journal of Graphs"),
    "Keller, A. (2004) Networks of things. Journal of Graphs, 3(2), 1-9.": (["Keller, A."], 2004, "Networks of things", "Journal of Graphs"),
}


def test_plain_strings_of_six_styles(spark):
    rows = extract.parse_references(spark.createDataFrame([(t,) for t in PLAIN], "raw string")).collect()
    assert {r.raw: (r.authors, r.year, r.title, r.journal) for r in rows} == PLAIN


def test_masked_digits_keep_their_places(spark):
    texts = {"Graphs 3, pp. 1950-1960.": "Graphs 3, pp. ####-####.", "12:1990–1999": "12:####–####", "no. May 2023, 2004": "no. May ####, 2004", "p. 2001 (2004)": "p. #### (2004)", "2004;12:3-9": "2004;12:3-#"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", extract.mask_digits(F.col("t")).alias("m"), extract.late_year(F.col("t")).alias("y")).collect()
    assert {r.t: r.m for r in rows} == texts and all(len(r.t) == len(r.m) for r in rows)
    assert {r.t: r.y for r in rows}["no. May 2023, 2004"] == "2004" and {r.t: r.y for r in rows}["12:1990–1999"] is None


def test_headers(spark):
    yes = ["References", "5. KAYNAKLAR VE EKLER", "KAYNAKÇA LİSTESİ", "EK-1: KAYNAKLAR", "Bibliography :", "WORKS CITED", "Literatür"]
    no = ["References to older work", "Our sources", "A line that names Kaynaklar far too late to be a header of anything", ""]
    rows = spark.createDataFrame([(x,) for x in yes + no], "t string").select("t", layout.is_header(F.col("t")).alias("h")).collect()
    assert {r.t for r in rows if r.h} == set(yes)


def test_numbers_that_hold(spark):
    numbers = {"from one": [1, 2, 3], "short": [2, 1], "late": [11, 12, 13], "falling": [9, 8, 7, 6], "one": [10], "mixed": [1, 5, 2, 3]}
    rows = [(d, i, n) for d, ns in numbers.items() for i, n in enumerate(ns)]
    got = layout.valid_splits(spark.createDataFrame(rows, "doc_id string, line_no int, ref_no long")).collect()
    assert {r.doc_id for r in got} == {"from one", "short", "one", "mixed"}


def test_screened_instructions_and_headers_in_one_pass(spark):
    texts = ["1001BF-02 form", "Bu bölümde yer", "Proje önerisinde", "17. sayfasındaki AÇIKLAMALARA", "verilmeli ve bu kaynaklara", "listenin sonuna DOI numarası", "İçerisinde ilgili yerlerde", "Güncelleme tarihi", "ZORUNLUDUR..", "YAPILMALIDIR"]
    texts += ["kaynakların listesi", "bibliyografik", "verilerin-duzenlenmesi", "böyle eklenmesi ", "Kurum İçi Sınırsız Kullanım / Kişisel Veri Değil", " 2020 - BF Güncelleme Tarihi: 01/02/2020 ", "a plain line of the end", "[1] Keller", "12) Weber", "3-4 pages", "2020. Title", "7- Moreau", "[12 x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = layout.any_of(F.col("t"), layout.INSTRUCTIONS, "(?iu)")
    got = rows.select("t", layout.is_instruction(F.col("t")).alias("a"), plain.alias("b"), layout.line_number(F.col("t")).alias("n")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.b for r in got) == 16
    assert [r.n for r in got][16:] == [None, 1, 12, None, None, 7, None]
    body = ["title page", "References", "x", "References", "Keller, A. one", "Weber, B. two", "Novak, C. three", "References"]
    lines = spark.createDataFrame([(d, 1 + i // 4, i % 4, t, 0.0, i * 12.0, 9.0, i * 12.0 + 10) for d in (1, 2) for i, t in enumerate(body[d - 1 :])], "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    rows = layout.number_lines(lines)
    assert sorted(r.line_no for r in rows.where("doc_id = 1").collect()) == list(range(8))
    want = layout.lines_after_header(rows, layout.find_header(rows)).select("doc_id", "line_no")
    assert sorted(map(tuple, layout.lines_below_header(rows).select("doc_id", "line_no").collect())) == sorted(map(tuple, want.collect())) != []


def test_patterns_stay_linear_in_long_texts(spark):
    """A long text without a bracketed year, and a title longer than Java's stack would recurse over."""
    from time import time

    long = "Keller, A. 2001. " + "maps and things " * 4000 + "Annals of Maps"
    rows = spark.createDataFrame([(1, long)], "ref_id int, raw string")
    began = time()
    out = extract.parse_references(rows).select("year", F.length("title").alias("n"), extract.late_year(F.lit("x " * 20000)).alias("late")).first()
    assert (out.year, out.late) == (2001, None) and out.n > 60000 and time() - began < 30
