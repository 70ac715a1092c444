import re
from collections import Counter, defaultdict

import duckdb
import pytest

from bibweave.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least, top):
    """The contract's words over dictionaries; every pair of sources and every kept term is met."""
    held, uses, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        groups[lang].add(source)
        held[lang].update(set(terms))
        uses[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in held[lang].items() if n >= least}
        counts = {s: {t: uses[lang, s][t] for t in kept} for s in sources}
        total = {t: sum(c[t] for c in counts.values()) for t in kept}
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: B023, E731
        for s in sources:
            pairs = [(-sum(abs(p(counts[s], t) - p(counts[o], t)) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(p(total, t) - p(counts[s], t), t.encode(), t) for t in kept if counts[s][t] and p(counts[s], t) > p(total, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


ROWS = [
    ("The cat, the CAT", "en", "a"), ("The cat, the CAT", "en", "a"), ("The cat, the CAT", "en", "b"), ("the dog\x00dog", "en", "b"), ("dog cat é", "en", None), (None, "en", "empty"), ("", "en", "empty"),
    ("the cat", None, "a"), ("the cat", "", "b"), ("été Été ÉTÉ x1y_z", "fr", "a"), ("été x y z", "fr", "b"), ("alone", "de", "a"), ("rare words", "de", "b"), ("tie tie tak tak", "fr", "ü"), ("tak tie", "fr", "z"),
]


@pytest.mark.parametrize("least, top", [(1, 50), (2, 2), (3, 50), (100, 50)])
def test_against_brute_force(spark, least, top):
    """Copies within and across sources, nulls, empty texts, sources without terms, ties, a language that keeps nothing."""
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], SCHEMA).selectExpr("*", "1 AS n", "'x' AS copies", "2 AS digest", "3 AS term")
    assert rows_of(divergence.audit(docs, least_docs=least, top=top)) == brute(ROWS, least, top)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_count_their_terms_once(spark, monkeypatch):
    """Texts of many slices, between short ones: a document is counted once however many slices hold its term."""
    monkeypatch.setattr(divergence, "SLICE", 64)
    monkeypatch.setattr(divergence, "HELD", 2)
    rows = [("one two three " * 40, "en", "a"), ("two", "en", "a"), ("three four " * 30 + "one", "en", "b"), ("x" * 500 + " one", "en", "b"), ("four", "en", "c")]
    import pyarrow as pa

    copies = pa.array([[{"source": s, "n": 1}] for _, _, s in rows], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows]), copies], ["lang", "text", "copies"])
    got = defaultdict(lambda: [0, 0])
    for part in divergence.combined_counts([batch]):
        for r in part.to_pylist():
            got[r["source"], r["term"]][0] += r["uses"]
            got[r["source"], r["term"]][1] += r["docs"]
    want = defaultdict(lambda: [0, 0])
    for text, _, s in rows:
        for t, n in Counter(text.split()).items():
            want[s, t][0] += n
            want[s, t][1] += 1
    assert got == want


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.ORACLES['op11_source_divergence']})").fetchall()
    assert want and rows_of(queries.op11_source_divergence(spark, sf_dir)) == sorted(want)
