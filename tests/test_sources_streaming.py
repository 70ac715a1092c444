"""Readers, writers and catalogs on hand-written rows; streams against their batch forms."""

import json

from pyspark.sql import functions as F

from bibweave.plans import queries
from bibweave.plans.derived import FEED, view
from bibweave.sources import catalogs, files, snapshots
from bibweave.streaming import feeds


def put(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_catalogs(spark, tmp_path):
    rows = {
        "crossref": [{"DOI": "10.1/A", "title": ["T"], "author": [{"family": "Lee", "given": "Kim"}, {"family": "Solo"}], "container-title": ["J"], "published-online": {"date-parts": [[2020, 1]]}, "issued": {"date-parts": [[2019]]}, "page": "1-9"}, {"DOI": "10.1/b"}],
        "openalex": [{"id": "W1", "display_name": "T", "authorships": [{"author": {"display_name": "Kim Lee"}}], "publication_year": 2020, "doi": "https://doi.org/10.1/a", "biblio": {"first_page": "1", "last_page": "9"}, "primary_location": {"source": {"display_name": "J", "issn_l": "1-1", "issn": ["2-2"]}}}],
        "pubmed": [{"uid": "7", "title": "T", "authors": [{"name": "Lee K"}], "pubdate": "2020 Jan", "articleids": [{"idtype": "pii", "value": "x"}, {"idtype": "doi", "value": "10.1/A"}], "source": "J", "fulljournalname": ""}],
        "semantic_scholar": [{"paperId": "p", "title": "T", "authors": [{"name": "Kim Lee"}], "year": 2020, "externalIds": {"DOI": "10.1/a"}, "venue": "J"}],
        "europe_pmc": [{"id": "9", "source": "MED", "title": "T", "authorString": "Lee K, Solo A.", "pubYear": "2020", "doi": "10.1/a", "journalTitle": "J"}],
        "open_library": [{"key": "/works/1", "title": "T", "author_name": ["Kim Lee"], "first_publish_year": 2020, "publisher": ["P", "Q"]}],
        "openaire": [{"id": "o", "mainTitle": "T", "authors": [{"fullName": None, "name": "Kim"}], "publicationDate": "2020-02-02", "pids": [{"scheme": "DOI", "value": "10.1/a"}], "container": {"name": "J", "sp": "1", "ep": "1", "issnPrinted": "1-1", "issnOnline": "1-1"}}],
    }
    got = {}
    for name, records in rows.items():
        df = catalogs.read_catalog(spark, name, put(tmp_path / f"{name}.json", records))
        assert df.columns == catalogs.COLUMNS
        (got[name],) = df.collect()
        assert got[name].title == "T" and got[name].year == 2020
    assert got["crossref"].authors == ["Lee, Kim", "Solo"] and got["crossref"].url == "https://doi.org/10.1/a"
    assert (got["openalex"].doi, got["openalex"].pages, got["openalex"].issn) == ("10.1/a", "1-9", ["1-1", "2-2"])
    assert (got["pubmed"].doi, got["pubmed"].journal) == ("10.1/a", "J")
    assert got["europe_pmc"].authors == ["Lee K", "Solo A"] and got["open_library"].publisher == "P"
    assert (got["openaire"].authors, got["openaire"].pages, got["openaire"].issn) == (["Kim"], "1", ["1-1"])
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>T\n x</title><published>2021-01-01</published><author><name>Kim</name></author><author><name>Lee</name></author></entry><entry><id>http://arxiv.org/api/errors#1</id><title>Error</title></entry></feed>")
    (a,) = catalogs.read_catalog(spark, "arxiv", str(tmp_path / "a.xml")).collect()
    assert (a.work_id, a.title, a.year, a.journal) == ("2101.00001", "T x", 2021, "arXiv")


def test_files(spark, tmp_path):
    doc = {"id": "d", "pages": [{"page_num": 1, "text_blocks": [{"text": "a", "bbox": [1, 2, 3, 4]}, {"text": "b", "bbox": [1, 2, 3, 4], "is_bold": True}]}]}
    assert [(r.text, r.line_no, r.x1) for r in files.read_text_blocks(spark, put(tmp_path / "d.json", [doc])).collect()] == [("a", 0, 3.0), ("b", 1, 3.0)]
    (tmp_path / "refs").mkdir()
    put(tmp_path / "refs" / "1.json", [{"pdf_id": "p", "approved": True, "page_count": "x", "sources": [{"id": "s", "text": "t", "ref_number": 1, "bboxes": [{"x0": 1.005, "y0": 1, "x1": 2, "y1": 3.333, "page": 1}]}]}])
    (tmp_path / "refs" / "2.json").write_text("{not json")
    refs = files.read_references(spark, str(tmp_path / "refs"))
    (r,) = refs.collect()
    assert (r.ref_id, r.status, r.page_count) == ("s", "approved", None)
    files.write_references(refs, str(tmp_path / "out"))
    (w,) = snapshots.open_snapshot(spark, str(tmp_path / "out")).rows(files.STORED_REFERENCES, "json").collect()
    assert w.approved and w.sources[0].bboxes[0].y1 == 3.33
    # another document is added beside it; what a later write doesn't know keeps its value
    known = refs.withColumns({"doc_id": F.lit("q"), "page_count": F.lit(7), "numbered": F.lit(True), "status": F.lit("detected")})
    files.write_references(known, str(tmp_path / "out"))
    before = files.read_references(spark, str(tmp_path / "out"))
    files.write_references(before.drop("page_count", "numbered").where("doc_id = 'q'"), str(tmp_path / "out"))
    again = {r.doc_id: r for r in files.read_references(spark, str(tmp_path / "out")).collect()}
    assert set(again) == {"p", "q"} and (again["q"].page_count, again["q"].numbered) == (7, True)
    assert {r.doc_id: r.approved for r in files.all_approved(before).collect()} == {"p": True, "q": False}
    (tmp_path / "l.jsonl").write_text('{"id": "1", "text": "x", "entities": []}\n\n{oops\n')
    assert sorted((r.line_no, r.malformed) for r in files.read_span_labels(spark, str(tmp_path / "l.jsonl")).collect()) == [(1, False), (3, True)]
    (tmp_path / "r.txt").write_text("# c\nThesis | by hand\n\n@non-doi-url | link\n")
    assert [(r.word, r.reason, r.kind) for r in files.read_exclusion_rules(spark, str(tmp_path / "r.txt")).orderBy("ord").collect()] == [("thesis", "by hand", None), (None, "link", "non-doi-url")]
    assert [(r.word, r.kind) for r in files.read_exclusion_rules(spark).orderBy("ord").collect()] == [(None, "non-doi-url"), ("arxiv", None), ("proceedings", None), ("oecd", None)]


def run(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_their_batch_forms(spark, sf_dir, tmp_path):
    events = view(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "events")
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(source)
    stream = feeds.read_feed(spark, source, events.schema, files_per_trigger=10)
    live = spark.sql(FEED, events=stream)
    batch = spark.sql(FEED, events=spark.read.parquet(source))
    rates = run(feeds.outcome_rates(live), "rates", spark, "complete")
    assert sorted(rates.collect()) == sorted(feeds.outcome_rates(batch).collect())
    assert run(feeds.dedup_events(live.union(live), "event_id"), "once", spark).count() == batch.count()
    steps = spark.sql(FEED, events=feeds.read_feed(spark, source, events.schema))
    feeds.progress_stream(steps, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(120)
    want = feeds.latest_progress(batch)
    assert sorted(feeds.read_progress(spark, str(tmp_path / "store")).select(want.columns).collect()) == sorted(want.collect())
    last = feeds.last_events(batch, 3).collect()
    assert {(r.source_db, r.n) for r in last} == {(f"db{i}", n) for i in range(11) for n in (1, 2, 3)}


def test_verify_stream(spark, sf_dir, tmp_path):
    refs = queries.citations(spark, sf_dir).limit(60)
    refs.write.parquet(str(tmp_path / "refs"))
    works = queries.works(spark, sf_dir)
    stored = spark.read.parquet(str(tmp_path / "refs"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "refs"))
    out = str(tmp_path / "out")
    feeds.verify_stream(stream, works, lambda df, epoch: df.write.mode("append").parquet(out), str(tmp_path / "ck")).awaitTermination(200)
    from bibweave.operators.linkage import verify

    assert sorted(spark.read.parquet(out).collect(), key=str) == sorted(verify(stored, works).collect(), key=str)
