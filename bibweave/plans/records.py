"""Queries over catalog records: each work of the derived catalog is written in a database's own JSON form, read back through that
database's reader, and compared with SQL over the catalog itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibweave.plans.derived import CATALOG, catalog, duck
from bibweave.plans.queries import query
from bibweave.sources import catalogs

A1, A2 = "split_part(authors, '; ', 1)", "split_part(authors, '; ', 2)"
FAMILY1, GIVEN1, FAMILY2 = f"split_part({A1}, ', ', 1)", f"split_part({A1}, ', ', 2)", f"split_part({A2}, ', ', 1)"
DATED = "named_struct('date-parts', array(array({year})))"

#: Of each database: its record as Spark SQL, and what a reader must find, as SQL for both engines; fields left out are empty.
FORMS: dict[str, tuple[str, dict[str, str]]] = {
    "crossref": (
        f"""named_struct('DOI', upper(doi), 'title', array(title), 'author', array(named_struct('family', {FAMILY1}, 'given', {GIVEN1}), named_struct('family', {FAMILY2}, 'given', CAST(NULL AS STRING))), 'container-title', array(journal),
            'page', '1-9', 'volume', '3', 'type', 'journal-article', 'ISSN', array('1234-5678'), 'published-print', CASE WHEN work_id % 2 = 0 THEN {DATED.format(year="year")} END, 'issued', {DATED.format(year="year + 1")})""",
        {"work_id": "doi", "authors": f"concat({A1}, '; ', {FAMILY2})", "year": "year + work_id % 2", "doi": "doi", "journal": "journal", "url": "concat('https://doi.org/', doi)", "pages": "'1-9'", "volume": "'3'", "document_type": "'journal-article'", "issn": "'1234-5678'"},
    ),
    "openalex": (
        f"""named_struct('id', concat('W', work_id), 'display_name', CASE WHEN work_id % 3 > 0 THEN title ELSE '' END, 'title', title, 'authorships', array(named_struct('author', named_struct('display_name', {A1}))),
            'publication_year', year, 'doi', CASE WHEN work_id % 2 = 0 THEN concat('https://doi.org/', doi) END, 'type', 'article', 'biblio', named_struct('first_page', '3', 'last_page', CASE WHEN work_id % 2 = 0 THEN '3' ELSE '8' END),
            'primary_location', named_struct('source', named_struct('display_name', journal, 'issn_l', '1111-1111', 'issn', array('2222-2222'))))""",
        {"work_id": "concat('W', work_id)", "authors": A1, "year": "year", "doi": "CASE WHEN work_id % 2 = 0 THEN doi ELSE '' END", "journal": "journal", "url": "CASE WHEN work_id % 2 = 0 THEN concat('https://doi.org/', doi) ELSE concat('W', work_id) END", "pages": "CASE WHEN work_id % 2 = 0 THEN '3' ELSE '3-8' END", "document_type": "'article'", "issn": "'1111-1111,2222-2222'"},
    ),
    "pubmed": (
        f"""named_struct('uid', CAST(work_id AS STRING), 'title', title, 'authors', array(named_struct('name', {A1}), named_struct('name', {A2})), 'pubdate', concat(year, ' Mar 3'), 'articleids', array(named_struct('idtype', 'pii', 'value', 'x'), named_struct('idtype', 'doi', 'value', doi)),
            'fulljournalname', CASE WHEN work_id % 2 = 0 THEN journal ELSE '' END, 'source', 'Short J', 'pages', '5-6', 'essn', '3333-3333', 'issn', '', 'pubtype', array('Journal Article'), 'lang', array('eng'))""",
        {"work_id": "CAST(work_id AS VARCHAR(20))", "authors": "authors", "year": "year", "doi": "doi", "journal": "CASE WHEN work_id % 2 = 0 THEN journal ELSE 'Short J' END", "url": "concat('https://pubmed.ncbi.nlm.nih.gov/', work_id, '/')", "pages": "'5-6'", "document_type": "'Journal Article'", "language": "'eng'", "issn": "'3333-3333'"},
    ),
    "semantic_scholar": (
        f"""named_struct('paperId', concat('s', work_id), 'title', title, 'authors', array(named_struct('name', {A1})), 'year', year, 'externalIds', named_struct('DOI', CASE WHEN work_id % 2 = 0 THEN doi END), 'url', concat('https://s.example/', work_id),
            'venue', journal, 'journal', named_struct('volume', '9', 'pages', ' 1-2 '), 'publicationTypes', array('Review'))""",
        {"work_id": "concat('s', work_id)", "authors": A1, "year": "year", "doi": "CASE WHEN work_id % 2 = 0 THEN doi ELSE '' END", "journal": "journal", "url": "CASE WHEN work_id % 2 = 0 THEN concat('https://doi.org/', doi) ELSE concat('https://s.example/', work_id) END", "volume": "'9'", "pages": "'1-2'", "document_type": "'Review'"},
    ),
    "europe_pmc": (
        f"""named_struct('id', CAST(work_id AS STRING), 'source', 'MED', 'title', title, 'authorString', concat({FAMILY1}, ' A, ', {FAMILY2}, ' B.'), 'pubYear', CASE WHEN work_id % 5 = 0 THEN 'n.d.' ELSE CAST(year AS STRING) END, 'doi', doi, 'journalTitle', journal, 'journalVolume', '4', 'issue', '2', 'pageInfo', '7',
            'journalIssn', '4444-4444', 'essn', '5555-5555', 'docType', 'article')""",
        {"work_id": "CAST(work_id AS VARCHAR(20))", "authors": f"concat({FAMILY1}, ' A; ', {FAMILY2}, ' B')", "year": "CASE WHEN work_id % 5 > 0 THEN year END", "doi": "doi", "journal": "journal", "url": "concat('https://europepmc.org/article/MED/', work_id)", "volume": "'4'", "issue": "'2'", "pages": "'7'", "document_type": "'article'", "issn": "'4444-4444,5555-5555'"},
    ),
    "open_library": (
        f"""named_struct('key', concat('/works/', work_id), 'title', title, 'author_name', array({A1}), 'first_publish_year', year, 'publisher', array('House', 'Other'), 'isbn', array('1', '2'), 'language', array('tur'))""",
        {"work_id": "concat('/works/', work_id)", "authors": A1, "year": "year", "url": "concat('https://openlibrary.org/works/', work_id)", "publisher": "'House'", "document_type": "'book'", "language": "'tur'", "isbn": "'1,2'"},
    ),
    "openaire": (
        f"""named_struct('id', concat('o', work_id), 'mainTitle', title, 'authors', array(named_struct('fullName', CASE WHEN work_id % 2 = 0 THEN {A1} ELSE '' END, 'surname', {FAMILY1}), named_struct('fullName', '', 'surname', '')), 'publicationDate', concat(year, '-05-01'),
            'pids', array(named_struct('scheme', 'handle', 'value', 'h'), named_struct('scheme', 'doi', 'value', CASE WHEN work_id % 3 > 0 THEN doi ELSE '' END)), 'instances', array(named_struct('urls', array(''), 'instancetype', named_struct('name', 'Article')), named_struct('urls', array(concat('https://o.example/', work_id)), 'instancetype', named_struct('name', 'Preprint'))),
            'container', named_struct('name', journal, 'sp', '1', 'ep', '4', 'issnPrinted', '6666-6666', 'issnOnline', '6666-6666'), 'language', CASE WHEN work_id % 2 = 0 THEN to_json(named_struct('code', 'en')) ELSE 'tr' END)""",
        {"work_id": "concat('o', work_id)", "authors": f"CASE WHEN work_id % 2 = 0 THEN {A1} ELSE {FAMILY1} END", "year": "year", "doi": "CASE WHEN work_id % 3 > 0 THEN doi ELSE '' END", "journal": "journal", "url": "CASE WHEN work_id % 3 > 0 THEN concat('https://doi.org/', doi) ELSE concat('https://o.example/', work_id) END", "pages": "'1-4'", "document_type": "'Article'", "language": "CASE WHEN work_id % 2 = 0 THEN 'en' ELSE 'tr' END", "issn": "'6666-6666'"},
    ),
    "arxiv": (
        f"""named_struct('id', concat('http://arxiv.org/abs/2101.', 10000 + work_id, 'v', work_id % 3 + 1), 'title', CASE WHEN work_id % 11 = 0 THEN 'Error' ELSE replace(title, ' for ', '\\n for ') END, 'author', array(named_struct('name', {A1})), 'published', concat(year, '-01-02T00:00:00Z'),
            'link', array(named_struct('_href', 'http://x/pdf', '_type', 'application/pdf'), named_struct('_href', concat('https://arxiv.org/abs/2101.', 10000 + work_id, 'v2'), '_type', CASE WHEN work_id % 2 = 0 THEN 'text/html' ELSE 'other' END)))""",
        {"work_id": "concat('2101.', 10000 + work_id)", "authors": A1, "year": "year", "journal": "'arXiv'", "url": "concat(CASE WHEN work_id % 2 = 0 THEN 'https' ELSE 'http' END, '://arxiv.org/abs/2101.', 10000 + work_id)", "document_type": "'preprint'", "language": "'en'", "WHERE": "work_id % 11 > 0"},
    ),
    "trdizin": (
        f"""named_struct('_id', concat('t', work_id), '_source', named_struct('abstracts', array(named_struct('title', ''), named_struct('title', CASE WHEN work_id % 7 > 0 THEN title ELSE '' END)), 'authors', array(named_struct('name', {A1}), named_struct('name', '')), 'publicationYear', year, 'doi', CASE WHEN work_id % 2 = 0 THEN doi END,
            'journal', named_struct('name', journal), 'page', CASE WHEN work_id % 3 = 0 THEN '11-12' END, 'startPage', '20', 'endPage', CASE WHEN work_id % 3 = 1 THEN '25' END, 'lang', ' TUR ', 'issue', CASE WHEN work_id % 2 = 0 THEN to_json(named_struct('number', '2', 'volume', '6')) ELSE '5' END, 'volume', '8'))""",
        {"work_id": "concat('t', work_id)", "authors": A1, "year": "year", "doi": "CASE WHEN work_id % 2 = 0 THEN doi ELSE '' END", "journal": "journal", "url": "CASE WHEN work_id % 2 = 0 THEN concat('https://doi.org/', doi) ELSE concat('https://search.trdizin.gov.tr/tr/yayin/detay/t', work_id) END", "volume": "CASE WHEN work_id % 2 = 0 THEN '6' ELSE '8' END", "issue": "CASE WHEN work_id % 2 = 0 THEN '2' ELSE '5' END", "pages": "CASE work_id % 3 WHEN 0 THEN '11-12' WHEN 1 THEN '20-25' ELSE '20' END", "language": "'tur'", "WHERE": "work_id % 7 > 0"},
    ),
    "base": (
        f"""named_struct('dcdocid', concat('b', work_id), 'dctitle', CASE WHEN work_id % 7 = 0 THEN NULL WHEN work_id % 2 = 0 THEN to_json(array(title, 'other')) ELSE title END, 'dccreator', CASE WHEN work_id % 2 = 0 THEN to_json(array({A1}, '', {A2})) ELSE {A1} END, 'dcyear', concat(year, '-01'), 'dcdoi', CASE WHEN work_id % 5 > 0 THEN to_json(array(doi)) END,
            'dcsource', journal, 'dclink', CASE work_id % 3 WHEN 0 THEN 'https://b.example/1 ; https://b.example/2' WHEN 1 THEN to_json(array('https://b.example/3')) END, 'dcpublisher', to_json(array('House')), 'dctype', 'thesis', 'dclanguage', 'eng', 'dcissn', to_json(array('7777-7777', '8888-8888')))""",
        {"work_id": "concat('b', work_id)", "authors": f"CASE WHEN work_id % 2 = 0 THEN authors ELSE {A1} END", "year": "year", "doi": "CASE WHEN work_id % 5 > 0 THEN doi ELSE '' END", "journal": "journal", "url": "CASE work_id % 3 WHEN 0 THEN 'https://b.example/1' WHEN 1 THEN 'https://b.example/3' ELSE CASE WHEN work_id % 5 > 0 THEN concat('https://doi.org/', doi) ELSE '' END END", "publisher": "'House'", "document_type": "'thesis'", "language": "'eng'", "issn": "'7777-7777,8888-8888'", "WHERE": "work_id % 7 > 0"},
    ),
    "wos": (
        f"""named_struct('uid', concat('WOS:', work_id), 'title', CASE WHEN work_id % 7 > 0 THEN title ELSE '' END, 'names', named_struct('authors', array(named_struct('displayName', CASE WHEN work_id % 2 = 0 THEN {A1} END, 'wosStandard', {A2}), named_struct('displayName', '', 'wosStandard', ''))), 'source', named_struct('sourceTitle', journal, 'publishYear', CAST(year AS STRING), 'volume', ' 12 ', 'issue', '',
            'pages', CASE work_id % 4 WHEN 0 THEN to_json(named_struct('range', '1-10', 'begin', '1')) WHEN 1 THEN to_json(named_struct('begin', '2', 'end', '9')) WHEN 2 THEN to_json(named_struct('begin', '4')) ELSE '77' END), 'identifiers', named_struct('doi', CASE WHEN work_id % 2 = 0 THEN doi END, 'eissn', '9999-9999'), 'links', named_struct('record', concat('https://w.example/', work_id)), 'types', array('Article', 'Other'))""",
        {"work_id": "concat('WOS:', work_id)", "authors": f"CASE WHEN work_id % 2 = 0 THEN {A1} ELSE {A2} END", "year": "year", "doi": "CASE WHEN work_id % 2 = 0 THEN doi ELSE '' END", "journal": "journal", "url": "CASE WHEN work_id % 2 = 0 THEN concat('https://doi.org/', doi) ELSE concat('https://w.example/', work_id) END", "volume": "'12'", "pages": "CASE work_id % 4 WHEN 0 THEN '1-10' WHEN 1 THEN '2-9' WHEN 2 THEN '4' ELSE '77' END", "document_type": "'Article'", "issn": "'9999-9999'", "WHERE": "work_id % 7 > 0"},
    ),
    "scholar": (
        f"""named_struct('cid', concat('c', work_id), 'title', concat(CASE WHEN work_id % 2 = 0 THEN '[PDF] [B] ' ELSE '' END, title), 'meta', concat({FAMILY1}, ' A, ', {FAMILY2}, ' B, … - ', journal, ', ', year, ' - x.example'), 'url', concat('https://g.example/', work_id), 'links', array('https://y.example', concat('https://doi.org/', doi, '?via=g')))""",
        {"work_id": "concat('c', work_id)", "authors": f"concat({FAMILY1}, ' A; ', {FAMILY2}, ' B')", "year": "year", "doi": "doi", "url": "concat('https://g.example/', work_id)"},
    ),
}
CHECKED = ["work_id", "source_db", "title", "authors", "year", "doi", "journal", "url", "volume", "issue", "pages", "publisher", "document_type", "language", "issn", "isbn"]


def records(spark: SparkSession, sf_dir: str, database: str) -> DataFrame:
    """The catalog as records of a database, parsed by its schema."""
    schema, _ = catalogs.DATABASES[database]
    json = catalog(spark, sf_dir).select(F.to_json(F.expr(FORMS[database][0])).alias("json"))
    return json.select(F.from_json("json", schema).alias("r")).select("r.*")


def harmonised(spark: SparkSession, sf_dir: str, database: str) -> DataFrame:
    return catalogs.named(catalogs.DATABASES[database][1](records(spark, sf_dir, database)))


def checked(df: DataFrame) -> DataFrame:
    """Lists joined, missing strings empty."""
    join = {"authors": "; ", "issn": ",", "isbn": ","}
    return df.select(*[F.coalesce(F.array_join(c, join[c]) if c in join else F.col(c), F.lit("")).alias(c) if c != "year" else F.col(c).cast("int").alias(c) for c in CHECKED])


def expected(database: str) -> str:
    want = {"source_db": f"'{database}'", "title": "title"} | FORMS[database][1]
    cols = ", ".join(f"{want.get(c, chr(39) * 2) if c != 'year' else f'CAST({want[c]} AS INT)'} AS {c}" for c in CHECKED)
    return f"SELECT {cols} FROM {duck(CATALOG)} WHERE {want.get('WHERE', 'true')}"


def _register(database: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checked(harmonised(spark, sf_dir, database))

    run.__name__ = f"catalog_{database}"
    query(expected(database))(run)


for _name in FORMS:
    _register(_name)


@query(" UNION ALL ".join(f"SELECT source_db, count(*) AS n, count(nullif(doi, '')) AS with_doi FROM ({expected(d)}) GROUP BY source_db" for d in FORMS))
def union_catalogs(spark, sf_dir):
    """All twelve databases in one table, counted."""
    rows = catalogs.union_catalogs([harmonised(spark, sf_dir, d) for d in FORMS])
    return rows.groupBy("source_db").agg(F.count("*").alias("n"), F.count(F.nullif("doi", F.lit(""))).alias("with_doi"))


_SCHOLAR = f"""SELECT concat('c', work_id) AS cid, CASE WHEN work_id % 3 = 0 AND work_id % 2 = 0 THEN concat(title, ' in full') ELSE title END AS title,
    CASE WHEN work_id % 3 = 0 AND work_id % 2 = 0 THEN authors ELSE concat({FAMILY1}, ' A; ', {FAMILY2}, ' B') END AS authors, CAST(year + CASE WHEN work_id % 3 = 0 AND work_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS year, doi, CASE WHEN work_id % 3 = 0 AND work_id % 2 = 0 THEN journal ELSE '' END AS journal, true AS scraped_truncated FROM {{c}}"""


@query(_SCHOLAR.format(c=duck(CATALOG)))
def enrich_scholar(spark, sf_dir):
    """Scholar rows, every third with a parsed citation, of which every second is sure."""
    rows = catalogs.scholar_rows(records(spark, sf_dir, "scholar"))
    parsed = catalog(spark, sf_dir).where("work_id % 3 = 0").select(
        F.concat(F.lit("c"), "work_id").alias("cid"), F.when(F.col("work_id") % 2 == 0, 0.3).otherwise(0.2).alias("parse_confidence"), F.concat("title", F.lit(" in full")).alias("title"),
        F.split("authors", "; ").alias("authors"), (F.col("year") + 1).alias("year"), F.lit("").alias("doi"), "journal",
    )
    out = catalogs.enrich_scholar(rows, parsed)
    return out.select("cid", "title", F.array_join("authors", "; ").alias("authors"), "year", "doi", "journal", "scraped_truncated")
