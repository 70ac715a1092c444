"""Catalog snapshots of twelve databases in one schema. Each normaliser is a projection of the database's nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["work_id", "source_db", "title", "authors", "year", "doi", "arxiv", "journal", "url", "volume", "issue", "pages", "publisher", "editors", "document_type", "language", "issn", "isbn"]
NAMES, CODES = "array<string>", "array<string>"


def _first(col: str | Column) -> Column:
    return F.get(col, F.lit(0))


def _filled(*cols) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in cols])


def _year(col) -> Column:
    return F.substring(F.col(col) if isinstance(col, str) else col, 1, 4).try_cast("int")


def _doi(col) -> Column:
    return F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?i)^https?://(dx\.)?doi\.org/", ""))


def _pages(a, b) -> Column:
    return F.when(_filled(b).isNull() | (_filled(a) == _filled(b)), _filled(a)).otherwise(F.concat_ws("-", _filled(a), _filled(b)))


def _names(names: Column) -> Column:
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def _member(col: str, name: str) -> Column:
    """A member of a field that is an object in some records (read as its JSON text) and a plain string in others."""
    return F.when(F.startswith(F.trim(col), F.lit("{")), F.get_json_object(col, f"$.{name}")).otherwise(F.col(col))


def _listed(col: str) -> Column:
    """A field that is a list in some records (read as its JSON text) and a plain string in others."""
    return _names(F.when(F.startswith(F.trim(col), F.lit("[")), F.from_json(col, "array<string>")).otherwise(F.array(col)))


def _resolver(doi) -> Column:
    return F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit("")))


def _shaped(df: DataFrame, source_db: str, work_id: Column, **columns: Column) -> DataFrame:
    kinds = {"authors": NAMES, "editors": NAMES, "issn": CODES, "isbn": CODES, "year": "int"}
    given = {"work_id": work_id, "source_db": F.lit(source_db)} | columns
    return df.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


PERSON = "struct<family: string, given: string>"
CROSSREF = f"DOI string, title array<string>, author array<{PERSON}>, editor array<{PERSON}>, `container-title` array<string>, volume string, issue string, page string, publisher string, type string, language string, ISSN array<string>, ISBN array<string>, " + ", ".join(f"`{k}` struct<`date-parts`: array<array<int>>>" for k in ("published-print", "published-online", "published", "issued"))


def crossref(df: DataFrame) -> DataFrame:
    people = lambda c: F.transform(c, lambda p: F.regexp_replace(F.concat_ws(", ", p.family, p.given), r"^[,\s]+|[,\s]+$", ""))
    year = F.coalesce(*[_first(_first(F.col(f"`{k}`.`date-parts`"))) for k in ("published-print", "published-online", "published", "issued")])
    doi = _doi("DOI")
    return _shaped(df, "crossref", doi, title=_first("title"), authors=people("author"), editors=people("editor"), year=year, doi=doi, journal=_first("`container-title`"), url=_resolver(doi), volume=F.col("volume"), issue=F.col("issue"), pages=F.col("page"), publisher=F.col("publisher"), document_type=F.col("type"), language=F.col("language"), issn=F.col("ISSN"), isbn=F.col("ISBN"))


OPENALEX = "id string, display_name string, title string, authorships array<struct<author: struct<display_name: string>>>, publication_year int, doi string, language string, type string, biblio struct<volume: string, issue: string, first_page: string, last_page: string>, primary_location struct<landing_page_url: string, source: struct<display_name: string, issn_l: string, issn: array<string>, host_organization_name: string>>"


def openalex(df: DataFrame) -> DataFrame:
    source, doi = "primary_location.source", _doi("doi")
    issn = F.coalesce(f"{source}.issn", F.array().cast(CODES))
    lead = F.col(f"{source}.issn_l")
    issn = F.when(lead.isNotNull() & ~F.array_contains(issn, lead), F.concat(F.array(lead), issn)).otherwise(issn)
    return _shaped(df, "openalex", F.col("id"), title=_filled("display_name", "title"), authors=F.transform("authorships", lambda a: a.author.display_name), year=F.col("publication_year"), doi=doi, journal=F.col(f"{source}.display_name"), url=F.coalesce(F.col("primary_location.landing_page_url"), _resolver(doi), F.col("id")), volume=F.col("biblio.volume"), issue=F.col("biblio.issue"), pages=_pages("biblio.first_page", "biblio.last_page"), publisher=F.col(f"{source}.host_organization_name"), document_type=F.col("type"), language=F.col("language"), issn=issn)


PUBMED = "uid string, title string, authors array<struct<name: string>>, pubdate string, articleids array<struct<idtype: string, value: string>>, fulljournalname string, source string, volume string, issue string, pages string, issn string, essn string, pubtype array<string>, lang array<string>"


def pubmed(df: DataFrame) -> DataFrame:
    doi = _doi(_first(F.transform(F.filter("articleids", lambda a: a.idtype == "doi"), lambda a: a.value)))
    codes = F.filter(F.array(_filled("issn"), _filled("essn")), lambda x: x.isNotNull())
    return _shaped(df, "pubmed", F.col("uid"), title=F.col("title"), authors=F.transform("authors", lambda a: a["name"]), year=_year("pubdate"), doi=doi, journal=_filled("fulljournalname", "source"), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "uid", F.lit("/")), volume=F.col("volume"), issue=F.col("issue"), pages=F.col("pages"), document_type=_first("pubtype"), language=_first("lang"), issn=codes)


SEMANTIC_SCHOLAR = "paperId string, title string, authors array<struct<name: string>>, year int, externalIds struct<DOI: string, ArXiv: string>, url string, venue string, journal struct<volume: string, pages: string>, publicationTypes array<string>"


def semantic_scholar(df: DataFrame) -> DataFrame:
    doi = _doi("externalIds.DOI")
    return _shaped(df, "semantic_scholar", F.col("paperId"), title=F.col("title"), authors=F.transform("authors", lambda a: a["name"]), year=F.col("year"), doi=doi, arxiv=F.col("externalIds.ArXiv"), journal=F.col("venue"), url=F.coalesce(_resolver(doi), F.col("url")), volume=F.col("journal.volume"), pages=F.trim(F.col("journal.pages")), document_type=_first("publicationTypes"))


EUROPE_PMC = "id string, source string, title string, authorString string, pubYear string, doi string, journalTitle string, journalVolume string, issue string, pageInfo string, journalIssn string, essn string, pubType string, docType string"


def europe_pmc(df: DataFrame) -> DataFrame:
    names = F.filter(F.transform(F.split("authorString", ","), lambda a: F.regexp_replace(F.trim(a), r"\.$", "")), lambda a: a != "")
    codes = F.filter(F.array(_filled("journalIssn"), _filled("essn")), lambda x: x.isNotNull())
    return _shaped(df, "europe_pmc", F.col("id"), title=F.col("title"), authors=names, year=F.col("pubYear").try_cast("int"), doi=_doi("doi"), journal=F.col("journalTitle"), url=F.concat(F.lit("https://europepmc.org/article/"), "source", F.lit("/"), "id"), volume=F.col("journalVolume"), issue=F.col("issue"), pages=F.col("pageInfo"), document_type=_filled("pubType", "docType"), issn=codes)


OPEN_LIBRARY = "key string, title string, author_name array<string>, first_publish_year int, publisher array<string>, isbn array<string>, language array<string>"


def open_library(df: DataFrame) -> DataFrame:
    return _shaped(df, "open_library", F.col("key"), title=F.col("title"), authors=F.col("author_name"), year=F.col("first_publish_year"), journal=F.lit(""), url=F.concat(F.lit("https://openlibrary.org"), "key"), publisher=_first("publisher"), document_type=F.lit("book"), language=_first("language"), isbn=F.col("isbn"))


OPENAIRE = "id string, mainTitle string, authors array<struct<fullName: string, name: string, surname: string>>, publicationDate string, pids array<struct<scheme: string, value: string>>, instances array<struct<urls: array<string>, instancetype: struct<name: string>>>, container struct<name: string, vol: string, iss: string, sp: string, ep: string, issnPrinted: string, issnOnline: string>, publisher string, language string"


def openaire(df: DataFrame) -> DataFrame:
    doi = _doi(_first(F.transform(F.filter("pids", lambda p: F.lower(p.scheme) == "doi"), lambda p: p.value)))
    codes = F.array_distinct(F.filter(F.array(_filled("container.issnPrinted"), _filled("container.issnOnline")), lambda x: x.isNotNull()))
    return _shaped(df, "openaire", F.col("id"), title=F.col("mainTitle"), authors=_names(F.transform("authors", lambda a: _filled(a.fullName, a["name"], a.surname))), year=_year("publicationDate"), doi=doi, journal=F.col("container.name"), url=F.coalesce(_resolver(doi), _first(F.filter(F.flatten("instances.urls"), lambda u: u != ""))), volume=F.col("container.vol"), issue=F.col("container.iss"), pages=_pages("container.sp", "container.ep"), publisher=F.col("publisher"), document_type=_first("instances.instancetype")["name"], language=_member("language", "code"), issn=codes)


ARXIV = "id string, title string, author array<struct<name: string>>, published string, link array<struct<_href: string, _type: string>>, doi string"


def arxiv(df: DataFrame) -> DataFrame:
    """Atom entries (Spark's XML reader, row tag ``entry``); the feed's error entries are skipped."""
    rows = df.where((F.trim("title") != "Error") & ~F.contains("id", F.lit("/api/errors")))
    ident = F.regexp_replace(F.regexp_extract("id", r"/abs/(.+)$", 1), r"v\d+$", "")
    page = _first(F.transform(F.filter("link", lambda x: x._type == "text/html"), lambda x: x._href))
    return _shaped(rows, "arxiv", ident, title=F.trim(F.regexp_replace("title", r"\s+", " ")), authors=F.transform("author", lambda a: a["name"]), year=_year("published"), doi=_doi("doi"), arxiv=ident, journal=F.lit("arXiv"), url=F.regexp_replace(F.coalesce(page, F.col("id")), r"v\d+$", ""), document_type=F.lit("preprint"), language=F.lit("en"))


TRDIZIN = "_id string, _source struct<abstracts: array<struct<title: string>>, authors: array<struct<name: string>>, publicationYear: int, doi: string, journal: struct<name: string>, page: string, startPage: string, endPage: string, lang: string, language: string, issue: string, volume: string>"


def trdizin(df: DataFrame) -> DataFrame:
    """Records without a titled abstract have no title; volume and number are members of the issue where it is an object."""
    r = df.select("_id", "_source.*")
    title = _first(_names(F.transform("abstracts", lambda a: a.title)))
    pages = F.coalesce(_filled("page"), F.nullif(F.concat_ws("-", _filled("startPage"), _filled("endPage")), F.lit("")))
    doi = F.coalesce(_doi("doi"), F.lit(""))
    page = F.concat(F.lit("https://search.trdizin.gov.tr/tr/yayin/detay/"), "_id")
    volume = F.coalesce(_filled(F.get_json_object("issue", "$.volume")), _filled("volume"))
    return _shaped(r, "trdizin", F.col("_id"), title=title, authors=_names(F.transform("authors", lambda a: a["name"])), year=F.col("publicationYear"), doi=F.nullif(doi, F.lit("")), journal=F.col("journal.name"), url=F.when(doi != "", _resolver(doi)).otherwise(page), volume=volume, issue=_filled(_member("issue", "number")), pages=pages, language=F.lower(_filled("lang", "language")))


BASE = ", ".join(f"{c} string" for c in ("dcdocid", "dctitle", "dccreator", "dcyear", "dcdoi", "dcsource", "dclink", "dcidentifier", "dcpublisher", "dctype", "dclanguage", "dcissn", "dcisbn"))


def base(df: DataFrame) -> DataFrame:
    """Every field is a string or a list; a plain link may be several, separated by semicolons."""
    one = lambda c: _first(_listed(c))
    doi = _doi(one("dcdoi"))
    link = _filled("dclink", "dcidentifier")
    url = F.when(F.startswith(link, F.lit("[")), _first(F.from_json(link, "array<string>"))).otherwise(F.split_part(link, F.lit(";"), F.lit(1)))
    return _shaped(df, "base", F.col("dcdocid"), title=one("dctitle"), authors=_listed("dccreator"), year=_year(one("dcyear")), doi=doi, journal=one("dcsource"), url=F.coalesce(_filled(url), _resolver(doi)), publisher=one("dcpublisher"), document_type=one("dctype"), language=one("dclanguage"), issn=_listed("dcissn"), isbn=_listed("dcisbn"))


WOS = "uid string, title string, names struct<authors: array<struct<displayName: string, wosStandard: string>>>, source struct<sourceTitle: string, publishYear: string, volume: string, issue: string, pages: string>, identifiers struct<doi: string, issn: string, eissn: string>, links struct<record: string>, types array<string>"


def wos(df: DataFrame) -> DataFrame:
    """Pages are an object (range, else begin and end) or a plain string."""
    part = lambda name: _filled(F.get_json_object("source.pages", f"$.{name}"))
    span = F.when(part("begin").isNotNull(), F.concat_ws("-", part("begin"), part("end")))
    pages = F.when(F.startswith("source.pages", F.lit("{")), F.coalesce(part("range"), span)).otherwise(_filled("source.pages"))
    doi = _doi("identifiers.doi")
    codes = _names(F.array(_filled("identifiers.issn", "identifiers.eissn")))
    authors = _names(F.transform("names.authors", lambda a: _filled(a.displayName, a.wosStandard)))
    return _shaped(df, "wos", F.col("uid"), title=F.col("title"), authors=authors, year=F.col("source.publishYear").try_cast("int"), doi=doi, journal=F.col("source.sourceTitle"), url=F.coalesce(_resolver(_filled(doi)), F.col("links.record")), volume=_filled("source.volume"), issue=_filled("source.issue"), pages=pages, document_type=_first("types"), issn=codes)


SCHOLAR = "cid string, title string, meta string, url string, links array<string>, apa_citation string"


def scholar_rows(df: DataFrame) -> DataFrame:
    """Result rows of a scholar search: cid, title without leading [..] marks, authors, year, doi, url, apa_citation, and whether
    the page cut the title or the line below it; rows without a title are dropped."""
    cut = F.contains("title", F.lit("…")) | F.contains("meta", F.lit("…"))
    title = F.trim(F.regexp_replace("title", r"^\s*(?:\[[^\]]*\]\s*)+", ""))
    people = F.transform(F.split(F.split_part("meta", F.lit(" - "), F.lit(1)), ","), lambda a: F.trim(a))
    dois = F.filter(F.transform("links", lambda u: F.regexp_extract(u, r"doi\.org/(10\.\d{4,}/.+?)(?:[?&#]|$)", 1)), lambda d: d != "")
    rows = df.select("cid", title.alias("title"), F.filter(people, lambda a: (a != "") & (a != "…")).alias("authors"), F.regexp_extract("meta", r"\b((?:19|20)\d{2})\b", 1).try_cast("int").alias("year"), F.try_url_decode(_first(dois)).alias("doi"), "url", "apa_citation", F.coalesce(cut, F.lit(False)).alias("scraped_truncated"))
    return rows.where("title <> ''")


def enrich_scholar(rows: DataFrame, parsed: DataFrame, least: float = 0.3) -> DataFrame:
    """Scholar rows whose full citation was parsed (parsed: cid, parse_confidence, title, authors, year, doi, journal): with the
    confidence ``least`` or more each field that was found replaces the scraped one."""
    sure = parsed.where(F.col("parse_confidence") >= least).select("cid", *[F.col(c).alias(f"p_{c}") for c in ("title", "authors", "year", "doi", "journal")])
    known = {c: F.coalesce(_filled(f"p_{c}"), F.col(c)) for c in ("title", "doi")} | {"year": F.coalesce("p_year", "year"), "journal": F.coalesce("p_journal", F.lit(""))}
    known["authors"] = F.when(F.size("p_authors") > 0, F.col("p_authors")).otherwise(F.col("authors"))
    return rows.join(sure, "cid", "left").withColumns(known).drop(*[f"p_{c}" for c in ("title", "authors", "year", "doi", "journal")])


def scholar(df: DataFrame) -> DataFrame:
    r = scholar_rows(df)
    return _shaped(r, "scholar", F.col("cid"), title=F.col("title"), authors=F.col("authors"), year=F.col("year"), doi=_doi("doi"), journal=F.lit(""), url=F.col("url"))


DATABASES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "crossref": (CROSSREF, crossref), "openalex": (OPENALEX, openalex), "pubmed": (PUBMED, pubmed), "semantic_scholar": (SEMANTIC_SCHOLAR, semantic_scholar), "europe_pmc": (EUROPE_PMC, europe_pmc),
    "open_library": (OPEN_LIBRARY, open_library), "openaire": (OPENAIRE, openaire), "arxiv": (ARXIV, arxiv), "trdizin": (TRDIZIN, trdizin), "base": (BASE, base), "wos": (WOS, wos), "scholar": (SCHOLAR, scholar),
}


def named(works: DataFrame) -> DataFrame:
    """Works with a title; the others are dropped."""
    return works.where(F.coalesce(F.trim("title"), F.lit("")) != "")


def read_catalog(spark: SparkSession, database: str, path: str) -> DataFrame:
    """A snapshot (JSON lines; arXiv: Atom XML) in the common schema; rows without a title are dropped."""
    schema, normalise = DATABASES[database]
    raw = spark.read.schema(schema).option("rowTag", "entry").xml(path) if database == "arxiv" else spark.read.schema(schema).json(path)
    return named(normalise(raw))


def union_catalogs(catalogs: list[DataFrame]) -> DataFrame:
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
