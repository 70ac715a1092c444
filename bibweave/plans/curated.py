"""Queries over links, names, scores, comparisons, curation and reports. Inputs are derived from the tables by key arithmetic, so
that SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bibweave.functions import fuzzy, identifiers, names, text, urls
from bibweave.operators import compare, curation, extract, labels, linkage, reports
from bibweave.plans.derived import CATALOG, FEED, RAW, REFS, VERDICTS, _pick, FAMILIES, GIVEN, catalog, derived, duck, refs, view
from bibweave.plans.queries import citations, parsed, query, works
from bibweave.session import new_folder, persisted
from bibweave.sources import files, store

# --- links

LINKED = f"""SELECT ref_id, kind, CASE kind WHEN 0 THEN concat('see https://eur- lex.europa.eu/a', ref_number, ', Son') WHEN 1 THEN concat('at https://x.example/p/ q', ref_number, '.html) now') WHEN 2 THEN 'HTTP://y.example/a_ b and more'
    WHEN 3 THEN concat('https://a.example and https://a.example/deep/', ref_number, '.') WHEN 4 THEN 'no link here' WHEN 5 THEN 'https://a.example/x- https://b.example/longer/one' WHEN 6 THEN 'https://c.example/q?id= 5-7 end'
    WHEN 7 THEN 'https://d.example/ 23' WHEN 8 THEN concat('https://e.example/', ref_number, '}}}}"') WHEN 9 THEN 'https://f.example/a- "b"' WHEN 10 THEN 'https://g.example/aa, https://g.example/bb' ELSE '' END AS raw FROM ({REFS}) AS r"""
FIRST = """CASE kind WHEN 0 THEN concat('https://eur-lex.europa.eu/a', n) WHEN 1 THEN concat('https://x.example/p/q', n, '.html') WHEN 2 THEN 'HTTP://y.example/a_' WHEN 3 THEN 'https://a.example' WHEN 5 THEN 'https://a.example/x-'
    WHEN 6 THEN 'https://c.example/q?id=5-7' WHEN 7 THEN 'https://d.example/' WHEN 8 THEN concat('https://e.example/', n) WHEN 9 THEN 'https://f.example/a-' WHEN 10 THEN 'https://g.example/aa' END"""


@query(f"""SELECT ref_id, {FIRST} AS first_url, CASE kind WHEN 3 THEN concat('https://a.example/deep/', n) WHEN 5 THEN 'https://b.example/longer/one' ELSE {FIRST} END AS best_url,
    CASE kind WHEN 3 THEN concat('https://a.example/deep/', n) WHEN 5 THEN 'https://a.example' WHEN 4 THEN 'https://a.example' WHEN 11 THEN 'https://a.example' ELSE 'https://a.example' END AS preferred
    FROM (SELECT *, ref_number AS n FROM {duck(REFS)})""")
def repaired_urls(spark, sf_dir):
    rows = derived(spark, sf_dir, LINKED)
    labelled = F.lit("https://a.example")
    return rows.select("ref_id", urls.repair_url(F.col("raw")).alias("first_url"), urls.best_url(F.col("raw")).alias("best_url"), urls.preferred_url(labelled, F.col("raw")).alias("preferred"))


@query(f"""WITH u AS (SELECT ref_id, kind, CAST(i AS INT) AS "at", CASE WHEN i = 0 THEN {FIRST} WHEN kind = 3 THEN concat('https://a.example/deep/', n) WHEN kind = 5 THEN 'https://b.example/longer/one' WHEN kind = 10 THEN 'https://g.example/bb' END AS url FROM (SELECT *, ref_number AS n FROM {duck(REFS)}) CROSS JOIN (SELECT unnest([0, 1]) AS i))
    SELECT ref_id, "at", url, true AS needs_liveness, true AS safe, NOT (kind IN (3, 5) AND "at" = 0) AND NOT (kind = 10 AND "at" = 1) AS best FROM u WHERE url IS NOT NULL""")
def repair_urls(spark, sf_dir):
    return urls.repair_urls(derived(spark, sf_dir, LINKED))


HOSTS = ["10.0.0.1", "100.64.3.3", "127.0.0.1", "169.254.0.9", "172.31.255.1", "192.0.0.7", "192.168.1.1", "198.19.0.1", "203.0.113.9", "224.0.0.1", "[::1]", "[fe80::1]", "8.8.8.8", "172.32.0.1", "100.63.0.1", "[2606:4700::1]", "host.example", "host.example:8443", "host.example:22"]


@query(f"SELECT ref_id, l_at >= 12 AND l_at <> 18 AS safe FROM (SELECT ref_id, (cited_work + ref_number) % {len(HOSTS)} AS l_at FROM {duck(REFS)})")
def screen_addresses(spark, sf_dir):
    """Links to literal addresses, private, reserved and public, and to hosts with ports."""
    host = F.element_at(F.array(*map(F.lit, HOSTS)), ((F.col("cited_work") + F.col("ref_number")) % len(HOSTS) + 1).cast("int"))
    return refs(spark, sf_dir).select("ref_id", text.url_is_safe(F.concat(F.lit("https://"), host, F.lit("/x"))).alias("safe"))


SEARCHED = "SELECT work_id, d.db, CASE WHEN work_id % 10 = 0 THEN '' ELSE concat(title, ', a/b') END AS title FROM ({catalog}) AS c CROSS JOIN ({dbs}) AS d"
_DBS = " UNION ALL ".join(f"SELECT '{d}' AS db" for d in [*text.SEARCH_PAGES, "unknown"])
_PLUS, _PATH = "replace(replace(replace(title, ' ', '+'), ',', '%2C'), '/', '%2F')", "replace(replace(title, ' ', '%20'), ',', '%2C')"


@query(f"""SELECT work_id, db, CASE WHEN title = '' THEN '' ELSE CASE db WHEN 'crossref' THEN concat('https://search.crossref.org/search/works?q=', {_PLUS}, '&from_ui=yes') WHEN 'scholar' THEN concat('https://scholar.google.com/scholar?q=', {_PLUS})
    WHEN 'google' THEN concat('https://www.google.com/search?q=', {_PLUS}) WHEN 'openalex' THEN concat('https://openalex.org/works?search=', {_PATH}) WHEN 'arxiv' THEN concat('https://arxiv.org/search/?query=', {_PATH}, '&searchtype=all')
    WHEN 'semantic_scholar' THEN concat('https://www.semanticscholar.org/search?q=', {_PATH}) WHEN 'europe_pmc' THEN concat('https://europepmc.org/search?query=', {_PATH}) WHEN 'trdizin' THEN concat('https://search.trdizin.gov.tr/tr/yayin/ara?q=', replace(replace(title, ' ', '%20'), '/', '%2F'), '&order=relevance-DESC&page=1&limit=20')
    WHEN 'pubmed' THEN concat('https://pubmed.ncbi.nlm.nih.gov/?term=', {_PATH}) WHEN 'openaire' THEN concat('https://explore.openaire.eu/search/find?fv0=', {_PATH}, '&f0=q') WHEN 'open_library' THEN concat('https://openlibrary.org/search?q=', {_PATH})
    WHEN 'base' THEN concat('https://www.base-search.net/Search/Results?lookfor=', {_PATH}) WHEN 'wos' THEN concat('https://www.webofscience.com/wos/alldb/basic-search?q=', {_PATH}) ELSE '' END END AS url FROM ({SEARCHED.format(catalog=CATALOG.format(part="part"), dbs=_DBS)})""")
def search_pages(spark, sf_dir):
    rows = derived(spark, sf_dir, SEARCHED.format(catalog=CATALOG, dbs=_DBS))
    return rows.select("work_id", "db", text.search_url(F.col("db"), F.col("title")).alias("url"))


# --- names and venues

NAMED = f"""SELECT work_id, work_id % 6 AS form, family, given, CASE work_id % 6 WHEN 0 THEN concat(family, ', ', given) WHEN 1 THEN concat(substr(given, 1, 1), '. ', family) WHEN 2 THEN concat(family, ' ', substr(given, 1, 1), 'Q') WHEN 3 THEN concat(given, ' van der ', family) WHEN 4 THEN concat('KJ ', family) ELSE concat(family, ' Q.R.') END AS raw
    FROM (SELECT work_id, {_pick(FAMILIES, "work_id")} AS family, {_pick(GIVEN, "work_id")} AS given FROM ({CATALOG}) AS c) AS n"""


@query(f"""SELECT DISTINCT raw, CASE form WHEN 3 THEN concat('van der ', lower(family)) ELSE lower(family) END AS last, CASE form WHEN 2 THEN concat(lower(substr(given, 1, 1)), ',q') WHEN 4 THEN 'k,j' WHEN 5 THEN 'q,r' ELSE lower(substr(given, 1, 1)) END AS initials, CASE WHEN form IN (0, 3) THEN lower(given) END AS given FROM {duck(NAMED)}""")
def build_author_dim(spark, sf_dir):
    return names.author_dim(derived(spark, sf_dir, NAMED)).select("raw", "last", F.array_join("initials", ",").alias("initials"), "given")


@query(f"SELECT work_id, concat(lower(family), ' muller yilmaz oe ', lower(given)) AS name FROM {duck(NAMED)}")
def normalize_name(spark, sf_dir):
    return derived(spark, sf_dir, NAMED).select("work_id", names.normalize_name(F.concat_ws("  ", "family", F.lit("Müller-Yılmaz; Œ"), "given")).alias("name"))


@query(f"SELECT work_id, CASE form WHEN 2 THEN concat(substr(given, 1, 1), 'Q') WHEN 5 THEN 'QR' ELSE family END AS family_name, CASE form WHEN 2 THEN concat(substr(given, 1, 1), 'Q ', family) WHEN 5 THEN concat('QR ', family) ELSE concat(family, ' Other') END AS author_query FROM {duck(NAMED)}")
def family_names(spark, sf_dir):
    """The last word is taken where there is no comma and no leading initials."""
    rows = derived(spark, sf_dir, NAMED)
    listed = F.array(F.lit("eds."), F.col("raw"), F.when(F.col("form").isin(2, 5), F.col("family")).otherwise(F.upper("family")), F.lit("Other, A."))
    return rows.select("work_id", names.family_name(F.col("raw")).alias("family_name"), names.author_query(listed).alias("author_query"))


@query(f"SELECT work_id, concat(family, ' A;', given) AS authors FROM {duck(NAMED)}")
def clean_scholar_authors(spark, sf_dir):
    rows = derived(spark, sf_dir, NAMED)
    listed = F.array(F.concat("family", F.lit(" A - Cells, 2020")), F.concat("given", F.lit("…")), F.lit("2024"), F.lit("(1999a)"), F.lit("12"))
    return rows.select("work_id", F.array_join(names.clean_scholar_authors(listed), ";").alias("authors"))


@query(f"""SELECT work_id, concat('intl j appl ', lower(topic)) AS short, concat('international journal applied ', lower(topic)) AS canonical FROM (SELECT work_id, split_part(title, ' ', 1) AS topic FROM {duck(CATALOG)})""")
def canonical_venues(spark, sf_dir):
    """Abbreviated venues with volumes, years, parentheses and subtitles."""
    topic = F.split_part("title", F.lit(" "), F.lit(1))
    raw = F.concat(F.lit("In: Int. J. Appl. "), topic, F.lit(" (Print), vol. 3, 2nd ed., 2011: a subtitle"))
    return catalog(spark, sf_dir).select("work_id", F.concat(F.lit("intl j appl "), F.lower(topic)).alias("short"), fuzzy.canonical_venue(raw).alias("canonical"))


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two DuckDB strings, row by row."""
    codes = lambda s: f"list_transform(string_split({s}, ''), lambda c: unicode(c))"
    row = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda acc, x: list_append(acc, CASE WHEN ac[x[1]] = ch[1] THEN prev[x[1]] + 1 ELSE greatest(acc[len(acc)], prev[x[1] + 1]) END), [CAST(0 AS BIGINT)])"
    return f"list_reduce(list_transform(bc, lambda c: [CAST(c AS BIGINT)]), lambda prev, ch: {row}, list_transform(range(length({a}) + 1), lambda z: CAST(0 AS BIGINT)))[length({a}) + 1]", codes(a), codes(b)


def _ratios(pairs: str, a: str, b: str, name: str) -> str:
    """DuckDB table with the ratio of the distinct pairs (a, b) of a table."""
    length, ac, bc = _lcs(a, b)
    return f"""(SELECT {a}, {b}, CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) + length({b}) = 0 OR {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * {length} / (length({a}) + length({b})) END AS {name} FROM (SELECT DISTINCT {a}, {b}, {ac} AS ac, {bc} AS bc FROM {pairs}))"""


def _sorted(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda t: t <> '')), ' ')"


NEIGHBOURS = f"SELECT a.work_id, a.journal AS x, b.journal AS y, a.title AS s, b.title AS t FROM ({CATALOG}) AS a JOIN ({CATALOG}) AS b ON a.work_id + 1 = b.work_id"


@query(f"""WITH n AS (SELECT *, {_sorted("x")} AS xs, {_sorted("y")} AS ys FROM {duck(NEIGHBOURS)}), r AS {_ratios("n", "x", "y", "plain")}, q AS {_ratios("n", "xs", "ys", "sorted")}
    SELECT work_id, round(plain, 6) AS indel, round(sorted, 6) AS token_sort FROM n JOIN r USING (x, y) JOIN q USING (xs, ys)""")
def similarity_ratios(spark, sf_dir):
    """U1 and U2 of the venues of neighbouring works."""
    rows = derived(spark, sf_dir, NEIGHBOURS)
    return rows.select("work_id", F.round(fuzzy.indel_ratio(F.col("x"), F.col("y")), 6).alias("indel"), F.round(fuzzy.token_sort_ratio(F.col("x"), F.col("y")), 6).alias("token_sort"))


@query(f"""WITH n AS (SELECT work_id, list_distinct(string_split(x, ' ')) AS a, list_distinct(string_split(y, ' ')) AS b FROM {duck(NEIGHBOURS)}),
    s AS (SELECT work_id, array_to_string(list_sort(list_filter(a, lambda w: list_contains(b, w))), ' ') AS shared, array_to_string(list_sort(list_filter(a, lambda w: NOT list_contains(b, w))), ' ') AS l, array_to_string(list_sort(list_filter(b, lambda w: NOT list_contains(a, w))), ' ') AS r FROM n), q AS {_ratios("s", "l", "r", "apart")}
    SELECT work_id, round(CASE WHEN shared <> '' AND (l = '' OR r = '') THEN 1.0 WHEN shared = '' THEN apart ELSE greatest(apart, 2.0 * length(shared) / (2 * length(shared) + 1 + length(l)), 2.0 * length(shared) / (2 * length(shared) + 1 + length(r))) END, 6) AS token_set FROM s JOIN q USING (l, r)""")
def token_set_ratios(spark, sf_dir):
    """U3 of the venues of neighbouring works."""
    return derived(spark, sf_dir, NEIGHBOURS).select("work_id", F.round(fuzzy.token_set_ratio(F.col("x"), F.col("y")), 6).alias("token_set"))


CITED = f"""SELECT r.ref_id, r.kind, w.work_id, w.source_db, lower(r.title) AS s, lower(w.title) AS t, r.authors AS ref_authors, w.authors AS work_authors, r.year AS ref_year, w.year AS work_year, r.journal AS ref_journal, w.journal AS work_journal, r.url, w.doi FROM ({REFS}) AS r JOIN ({CATALOG}) AS w ON r.cited_work = w.work_id"""
_VENUE = lambda c: _sorted(f"regexp_replace(lower({c}), '^(in|proceedings of the )', '')")

SCORED = f"""WITH p AS MATERIALIZED (SELECT *, {_sorted("s")} AS ss, {_sorted("t")} AS ts, CASE WHEN ref_journal = '' THEN '' ELSE {_VENUE("ref_journal")} END AS vs, {_VENUE("work_journal")} AS vt FROM {duck(CITED)}),
    a AS {_ratios("p", "s", "t", "plain")}, b AS {_ratios("p", "ss", "ts", "sorted")}, v AS {_ratios("p", "vs", "vt", "venue")},
    q AS (SELECT p.*, 0.6 * sorted + 0.4 * plain AS title_score, venue, CASE WHEN ref_authors = work_authors OR kind = 3 OR (kind = 6 AND (starts_with(work_authors, ref_initial) OR contains(work_authors, '; ' || ref_initial))) THEN 1.0 ELSE 0.0 END AS author_score, abs(ref_year - work_year) AS gap, url <> '' AS same_id
        FROM (SELECT *, substr(ref_authors, 1, length(ref_authors) - 1) AS ref_initial FROM p) p JOIN a USING (s, t) JOIN b USING (ss, ts) JOIN v USING (vs, vt)),
    z AS (SELECT *, round_even(0.75 * title_score + 0.25 * author_score + CASE WHEN gap <= 1 THEN 0.1 ELSE 0 END + CASE WHEN venue >= 0.75 THEN 0.1 ELSE 0 END + CASE WHEN same_id THEN 0.1 ELSE 0 END, 4) AS raw_score FROM q)"""


@query(f"""{SCORED} SELECT ref_id, round(title_score, 4) AS title_score, CAST(author_score AS DOUBLE) AS author_score, round(venue, 4) AS venue_score, round(raw_score, 4) AS raw_score, least(1.0, round(raw_score, 4)) AS score, raw_score >= 1.0 AND title_score >= 0.85 AS strong FROM z""")
def score_pairs(spark, sf_dir):
    """Every distinct citation against the work it was made from."""
    return _scored(spark, sf_dir).select("ref_id", "title_score", "author_score", F.round("venue_score", 4).alias("venue_score"), "raw_score", "score", linkage.strong_match(F.col("score"), F.col("title_score")).alias("strong"))


def _scored(spark, sf_dir):
    r = parsed(spark, sf_dir)
    return linkage.score_pairs(r.select("ref_id", F.col("cited_work").alias("work_id")), r.select("ref_id", "title", "authors", "year", "journal", "url"), works(spark, sf_dir))


@query(f"""{SCORED}, t AS (SELECT *, title_score >= 0.85 AS title_ok, author_score = 1 AS authors_ok, gap <= 1 AS year_ok, ref_journal <> '' AND venue >= 0.75 AS venue_ok, same_id AS id_ok FROM z)
    SELECT ref_id, CASE WHEN raw_score >= 0.75 THEN 'high' WHEN raw_score >= 0.5 THEN 'medium' ELSE 'low' END AS status,
        concat_ws(',', CASE WHEN NOT title_ok THEN '!title' END, CASE WHEN NOT authors_ok THEN '!authors' END, CASE WHEN NOT year_ok THEN '!year' END, CASE WHEN NOT venue_ok THEN '!journal' END, CASE WHEN NOT id_ok THEN '!doi/arXiv' END) AS tags,
        CASE WHEN authors_ok AND year_ok AND title_ok AND venue_ok THEN 'valid' WHEN title_ok OR (authors_ok AND (venue_ok OR id_ok)) THEN 'citation' ELSE 'fabricated' END AS decision FROM t""")
def judge_pairs(spark, sf_dir):
    """Status band, problem tags and decision of the same pairs."""
    found = F.col("work_id").isNotNull()
    return _scored(spark, sf_dir).select("ref_id", linkage.status_band(F.col("score")).alias("status"), F.array_join(linkage.problem_tags(found), ",").alias("tags"), linkage.decision_tag(found).alias("decision"))


@query(f"""{SCORED}, u AS (SELECT *, kind % 3 > 0 AS asked, round_even(0.75 * title_score + 0.25 * author_score + CASE WHEN same_id THEN 0.1 ELSE 0 END, 4) AS bare FROM z),
    t AS (SELECT *, asked AND raw_score > bare AS better, title_score >= 0.85 AS title_ok, author_score = 1 AS authors_ok FROM u),
    x AS (SELECT *, better AND gap <= 1 AS year_ok, CASE WHEN better THEN ref_journal <> '' AND venue >= 0.75 ELSE ref_journal = '' END AS venue_ok, same_id AS id_ok, CASE WHEN better THEN raw_score ELSE bare END AS final FROM t)
    SELECT ref_id, CASE WHEN better THEN 'scholar' ELSE source_db END AS source_db, CASE WHEN final >= 0.75 THEN 'high' WHEN final >= 0.5 THEN 'medium' ELSE 'low' END AS status, round(least(1.0, final), 3) AS score,
        concat_ws(',', CASE WHEN NOT title_ok THEN '!title' END, CASE WHEN NOT authors_ok THEN '!authors' END, CASE WHEN NOT year_ok THEN '!year' END, CASE WHEN NOT venue_ok THEN '!journal' END, CASE WHEN NOT id_ok THEN '!doi/arXiv' END) AS tags,
        CASE WHEN authors_ok AND year_ok AND title_ok AND venue_ok THEN 'valid' WHEN title_ok OR (authors_ok AND (venue_ok OR id_ok)) THEN 'citation' ELSE 'fabricated' END AS decision FROM x""")
def second_tier_verdicts(spark, sf_dir):
    """The first tier holds the cited works without year and venue; the second gives them whole, beside an earlier and a worse row,
    to two references of three."""
    r, w = parsed(spark, sf_dir), works(spark, sf_dir)
    fields = ("ref_id", "title", "authors", "year", "journal", "url")
    bare = w.withColumns({"year": F.lit(None).cast("int"), "journal": F.lit("")})
    old = linkage.score_pairs(r.select("ref_id", F.col("cited_work").alias("work_id")), r.select(*fields), bare)
    asked = r.where("kind % 3 > 0")
    both = w.unionByName(bare.withColumn("work_id", -F.col("work_id"))).withColumn("source_db", F.lit("scholar"))
    pairs = asked.select("ref_id", F.explode(F.array("cited_work", -F.col("cited_work"))).alias("work_id"))
    found = persisted(linkage.score_pairs(pairs, asked.select(*fields), both), "scholar")  # read twice
    earlier = found.where("work_id < 0").withColumn("raw_score", F.lit(9.0))
    out = linkage.second_tier_verdicts(old.unionByName(earlier), found)
    return out.select("ref_id", "source_db", "status", F.round("score", 3).alias("score"), F.array_join("problem_tags", ",").alias("tags"), "decision")


# --- linkage

ARXIV_REFS = f"SELECT ref_id, cited_work, CASE WHEN kind % 3 = 0 THEN concat('https://arxiv.org/abs/2101.', 10000 + cited_work, 'v', ref_number) ELSE url END AS url FROM ({REFS}) AS r"


@query(f"SELECT ref_id, cited_work AS work_id FROM (SELECT * FROM {duck(REFS)}) WHERE kind % 3 = 0 AND cited_work % 2 = 0")
def match_by_arxiv(spark, sf_dir):
    """Every second work has an arXiv id, in another version than the reference."""
    held = works(spark, sf_dir).withColumn("arxiv", F.when(F.col("work_id") % 2 == 0, F.concat(F.lit("2101."), 10000 + F.col("work_id"), F.lit("v9"))))
    return linkage.match_by_arxiv(derived(spark, sf_dir, ARXIV_REFS), held)


POOL = f"""SELECT r.ref_id, w.source_db, w.work_id, CAST((w.work_id * 7 + r.ref_number * 3) % 11 AS DOUBLE) AS weight, r.kind,
    CASE WHEN r.journal = w.journal THEN 1 ELSE 0 END + CASE WHEN split_part(r.authors, ',', 1) = split_part(w.authors, ',', 1) THEN 2 ELSE 0 END + CASE WHEN abs(r.year - w.year) <= 1 THEN 4 ELSE 0 END AS keys, CASE WHEN r.kind % 4 = 0 THEN 7 WHEN r.kind % 4 = 1 THEN 5 ELSE 4 END AS usable
    FROM ({REFS}) AS r JOIN (SELECT *, work_id - n AS near FROM ({CATALOG}) AS c CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 6 UNION ALL SELECT 9 UNION ALL SELECT 19) AS s) AS w ON r.cited_work = w.near"""


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY ref_id, source_db, level ORDER BY weight DESC, work_id) AS n FROM {duck(POOL)} CROSS JOIN (SELECT unnest(range(8)) AS level) WHERE (level & usable) = level AND (level & keys) = level)
    SELECT ref_id, source_db, work_id, count(*) AS levels FROM l WHERE n <= 2 GROUP BY ALL""")
def relaxation_lattice(spark, sf_dir):
    return linkage.relaxation_lattice(derived(spark, sf_dir, POOL), 2)


_SURNAME = "lower(split_part(w.authors, ',', 1)), lower(split_part(split_part(w.authors, '; ', 2), ',', 1))"
_SPECIFIC = "length(regexp_replace(lower(journal), '[^a-z]', '', 'g')) >= 6"


@query(f"""WITH r AS (SELECT DISTINCT concat_ws('/', surname, journal, year) AS ref_id, surname, journal, year FROM (SELECT split_part(authors, ',', 1) AS surname, journal, year FROM {duck(REFS)})),
    l AS (SELECT unnest([7, 6, 3, 5]) AS level), m AS (SELECT r.ref_id, l.level, w.source_db, w.work_id, CASE WHEN level & 4 > 0 THEN abs(w.year - r.year) ELSE 0 END AS gap FROM r JOIN l ON {_SPECIFIC.replace("journal", "r.journal")} OR level = 6 JOIN {duck(CATALOG)} w
        ON (level & 1 = 0 OR w.journal = r.journal) AND (level & 2 = 0 OR lower(r.surname) IN ({_SURNAME})) AND (level & 4 = 0 OR abs(w.year - r.year) <= 1) AND (w.journal = r.journal OR lower(r.surname) IN ({_SURNAME}))),
    n AS (SELECT *, row_number() OVER (PARTITION BY ref_id, source_db, level ORDER BY gap, work_id) AS n FROM m) SELECT ref_id, source_db, work_id, count(*) AS levels FROM n WHERE n <= 5 GROUP BY ALL""")
def block_by_fields(spark, sf_dir):
    """Every distinct surname, venue and year of the references, without a title, against the catalog."""
    rows = refs(spark, sf_dir).select(F.split_part("authors", F.lit(","), F.lit(1)).alias("surname"), "journal", "year").distinct()
    asked = rows.select(F.concat_ws("/", "surname", "journal", "year").alias("ref_id"), F.array(F.concat("surname", F.lit(", A."))).alias("authors"), "journal", "year")
    return linkage.block_by_fields(asked, works(spark, sf_dir))


@query(f"""SELECT p.ref_id, p.work_id FROM {duck(POOL)} p JOIN {duck(REFS)} r USING (ref_id) JOIN {duck(CATALOG)} w ON p.work_id = w.work_id WHERE split_part(r.authors, ',', 1) IN (split_part(w.authors, ',', 1), split_part(split_part(w.authors, '; ', 2), ',', 1))""")
def first_author_filter(spark, sf_dir):
    pool = derived(spark, sf_dir, POOL).select("ref_id", "work_id")
    return linkage.first_author_filter(pool, parsed(spark, sf_dir), works(spark, sf_dir))


@query(f"""SELECT ref_id, kind % 3 > 0 AND kind <> 4 AS use_author, kind NOT IN (10, 2) AS use_container, kind <> 5 AS use_year FROM {duck(REFS)}""")
def usable_keys(spark, sf_dir):
    rows = parsed(spark, sf_dir).withColumns(
        {
            "confidence": F.when(F.col("kind") % 3 == 0, 0.6).otherwise(0.7), "raw": F.when(F.col("kind") == 4, F.concat("title", F.lit(" Weber, editors, 2000"))).otherwise(F.col("title")),
            "journal": F.when(F.col("kind") == 2, "Proceedings.").otherwise(F.col("journal")), "year": F.when(F.col("kind") != 5, F.col("year")),
        }
    )
    return linkage.usable_keys(rows)


@query(f"""WITH p AS (SELECT ref_id, source_db AS db, work_id, weight / 8 AS raw_score, least(1.0, weight / 8) AS score FROM {duck(POOL)}), d AS (SELECT *, row_number() OVER (PARTITION BY ref_id, db ORDER BY score DESC, work_id) AS n FROM p WHERE score > 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY raw_score DESC, db, work_id) AS m FROM d WHERE n = 1) SELECT ref_id, db AS work_source_db, work_id, m = 1 AS best FROM b""")
def best_matches(spark, sf_dir):
    """The best work of each database by clamped score, and the best of these by unclamped score."""
    rows = derived(spark, sf_dir, POOL).select("ref_id", F.col("source_db").alias("work_source_db"), "work_id", (F.col("weight") / 8).alias("raw_score")).withColumn("score", F.least(F.lit(1.0), "raw_score"))
    ranked = linkage.ranked_databases(linkage.best_per_database(rows))
    return ranked.select("ref_id", "work_source_db", "work_id", (F.col("rank") == 1).alias("best"))


# --- comparison of extractions

SIDES = f"""SELECT ref_id, doc_id, ref_number, title, authors, year, journal, kind, CASE WHEN kind = 1 THEN 0.2 ELSE 0.9 END AS confidence, CASE WHEN kind = 2 THEN concat(journal, ', vol. 3, no. 2') ELSE journal END AS other_journal, CASE WHEN kind = 3 THEN 'Entirely different words' ELSE upper(title) END AS other_title,
    CASE WHEN kind = 5 THEN year + 1 ELSE year END AS other_year, CASE WHEN kind = 7 THEN split_part(authors, '; ', 1) ELSE authors END AS other_authors, CASE WHEN kind = 8 THEN '10.1/A' END AS doi, CASE WHEN kind = 8 THEN '10.1/a' WHEN kind = 9 THEN '10.1/b' END AS other_doi FROM ({REFS}) AS r"""


def sides(spark, sf_dir):
    rows = derived(spark, sf_dir, SIDES).withColumns({"a": F.split("authors", "; "), "b": F.split("other_authors", "; ")})
    ner = rows.select("ref_id", "title", F.col("a").alias("authors"), "year", "journal", "doi", F.col("confidence").cast("double").alias("parse_confidence"))
    regex = rows.select("ref_id", F.col("other_title").alias("title"), F.col("b").alias("authors"), F.col("other_year").alias("year"), F.col("other_journal").alias("journal"), F.col("other_doi").alias("doi"))
    return ner, regex


_DIVERGED = "kind = 3 AS title, false AS journal, kind = 7 AND length(authors) - length(replace(authors, '; ', ' ')) > 0 AND split_part(authors, ',', 1) <> split_part(split_part(authors, '; ', 2), ',', 1) AS authors, kind = 5 AS year, kind = 9 AS doi"


@query(f"SELECT ref_id, {_DIVERGED} FROM {duck(SIDES)} WHERE kind <> 1")
def compare_extractions(spark, sf_dir):
    out = compare.compare_extractions(*sides(spark, sf_dir))
    return out.select("ref_id", *[compare.diverged(f).alias(f) for f in compare.FIELDS])


@query(f"SELECT count(*) AS n, {', '.join(f'round(avg(CASE WHEN {f} THEN 1.0 ELSE 0 END), 6) AS {f}' for f in compare.FIELDS)} FROM (SELECT {_DIVERGED} FROM {duck(SIDES)} WHERE kind <> 1)")
def field_divergence(spark, sf_dir):
    out = compare.field_divergence(compare.compare_extractions(*sides(spark, sf_dir)))
    return out.select("n", *[F.round(c, 6).alias(c) for c in compare.FIELDS])


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, CAST(n AS INT) AS place, ref_id FROM (SELECT ref_id, row_number() OVER (ORDER BY ref_id) AS n FROM (SELECT ref_id, {_DIVERGED} FROM {duck(SIDES)} WHERE kind <> 1) WHERE {f}) WHERE n <= 5" for f in compare.FIELDS))
def example_rows(spark, sf_dir):
    return compare.example_rows(compare.compare_extractions(*sides(spark, sf_dir)), 5)


@query(f"""SELECT ref_id AS source_id, doc_id AS pdf_id, CAST(ref_number AS INT) AS ref, title AS ner_title, other_title AS regex_title, authors AS ner_authors, other_authors AS regex_authors, coalesce(doi, '') AS ner_doi, coalesce(other_doi, '') AS regex_doi, CAST(confidence AS DOUBLE) AS ner_conf, year = other_year AS year_match, CASE WHEN kind <> 3 THEN CAST(1 AS DOUBLE) END AS title_sim, CASE WHEN journal <> '' THEN CAST(1 AS DOUBLE) END AS journal_sim,
    CAST(CASE WHEN kind = 7 THEN round(1.0 / len(list_distinct(list_transform(string_split(authors, '; '), lambda x: lower(split_part(x, ',', 1))))), 3) ELSE 1 END AS DOUBLE) AS authors_jacc FROM {duck(SIDES)} WHERE kind <> 1""")
def comparison_rows(spark, sf_dir):
    """Rows of the comparison file. The similarity of two unlike titles is left to the tests of the ratio."""
    raw = refs(spark, sf_dir).withColumn("raw", F.col("title"))
    out = compare.comparison_rows(compare.compare_extractions(*sides(spark, sf_dir)), raw)
    return out.select("source_id", "pdf_id", F.col("ref").cast("int").alias("ref"), "ner_title", "regex_title", "ner_authors", "regex_authors", "ner_doi", "regex_doi", "ner_conf", "year_match", "journal_sim", "authors_jacc", F.when(F.col("title_sim") >= compare.TITLE, F.col("title_sim")).alias("title_sim"))


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN kind NOT IN (1, 4) THEN 1.0 ELSE 0 END), 6) AS rate FROM {duck(REFS)}")
def extraction_success_rate(spark, sf_dir):
    rows = parsed(spark, sf_dir).withColumns({"parse_confidence": F.when(F.col("kind") == 1, 0.29).otherwise(0.3), "year": F.when(F.col("kind") != 4, F.col("year"))})
    return compare.extraction_success_rate(rows).withColumn("rate", F.round("rate", 6))


@query(f"SELECT ref_id, CASE WHEN kind = 11 THEN 'regex' ELSE 'ner' END AS method FROM {duck(REFS)} WHERE kind <> 10")
def choose_extraction(spark, sf_dir):
    """The token model is unsure of kind 11 and lacks kind 10 on both sides."""
    rows = refs(spark, sf_dir).where("kind <> 10")
    ner = rows.select("ref_id", F.lit("ner").alias("method"), F.when(F.col("kind") == 11, 0.1).otherwise(0.8).alias("parse_confidence"))
    return labels.choose_extraction(ner, rows.select("ref_id", F.lit("regex").alias("method"), F.lit(0.5).alias("parse_confidence"))).select("ref_id", "method")


@query(f"SELECT ref_id, kind % 2 = 0 AS apa_like FROM {duck(REFS)}")
def apa_like(spark, sf_dir):
    raw = F.when(F.col("kind") % 4 == 0, F.concat("title", F.lit(" (2020a) x"))).when(F.col("kind") % 4 == 2, F.concat(F.lit("(1999)"), "title")).when(F.col("kind") % 4 == 1, F.concat(F.repeat(F.lit("long "), F.lit(60)), F.lit("(2020)"))).otherwise(F.col("title"))
    return refs(spark, sf_dir).select("ref_id", files.is_apa_like(raw).alias("apa_like"))


# --- curation and reports

@query(f"""SELECT coalesce(v.doc_id, o.o_orderkey) AS doc_id, count(*) FILTER (status = 'high') AS high, count(*) FILTER (status = 'medium') AS medium, count(*) FILTER (status = 'low') AS low, count(*) FILTER (status = 'in_progress') AS in_progress, count(status) AS total,
    count(*) FILTER (status = 'in_progress') = 0 AND (count(status) > 0 OR o_orderkey % 2 = 0) AS completed FROM orders o LEFT JOIN {duck(VERDICTS)} v ON v.doc_id = o.o_orderkey GROUP BY v.doc_id, o.o_orderkey""")
def document_status(spark, sf_dir):
    """The roll-up of every order, with and without results; the job of every second one is done."""
    documents = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 2 == 0).alias("job_done"))
    return reports.status_rollup(derived(spark, sf_dir, VERDICTS), documents)


@query(f"SELECT ref_no, string_agg(source_db, ',' ORDER BY ord, source_db) AS databases FROM (SELECT DISTINCT ref_no, source_db, CASE WHEN host < 8 THEN 7 - host ELSE 1000 END AS ord FROM {duck(FEED)}) GROUP BY ref_no")
def databases_in_order(spark, sf_dir):
    """Databases in a registry's order that is not the alphabet's; three are not listed."""
    rows = derived(spark, sf_dir, FEED)
    order = rows.where("host < 8").select("source_db", (7 - F.col("host")).cast("int").alias("ord")).distinct()
    return reports.databases_searched(rows, order).select("ref_no", F.array_join("databases", ",").alias("databases"))


@query(f"""SELECT doc_id, ref_number, CASE kind WHEN 1 THEN 'missing' WHEN 2 THEN 'extra' WHEN 3 THEN 'longer' WHEN 5 THEN 'shorter' ELSE 'changed' END AS kind, CASE kind WHEN 3 THEN length(title) + 1 WHEN 5 THEN length(title) WHEN 7 THEN 1 END AS diverges_at
    FROM (SELECT doc_id, ref_number, min(kind) AS kind, min(title) AS title FROM {duck(REFS)} GROUP BY ALL) WHERE kind IN (1, 2, 3, 5, 7)""")
def reference_differences(spark, sf_dir):
    rows = refs(spark, sf_dir).groupBy("doc_id", "ref_number").agg(F.min("kind").alias("kind"), F.min("title").alias("raw"))
    got = F.when(F.col("kind") == 3, F.concat("raw", F.lit("!"))).when(F.col("kind") == 5, F.col("raw").substr(F.lit(1), F.length("raw") - 1)).when(F.col("kind") == 7, F.concat(F.lit("#"), F.col("raw").substr(F.lit(2), F.length("raw")))).otherwise(F.col("raw"))
    return reports.reference_differences(rows.where("kind <> 2"), rows.where("kind <> 1").withColumn("raw", got))


@query(f"SELECT doc_id, ref_number, kind, want FROM (SELECT doc_id, ref_number, 'missing' AS kind, min(kind) AS k, min(title) AS want FROM {duck(REFS)} GROUP BY doc_id, ref_number) WHERE k = 1")
def missing_references(spark, sf_dir):
    """O4: what one side lacks, as rows."""
    rows = refs(spark, sf_dir).groupBy("doc_id", "ref_number").agg(F.min("kind").alias("k"), F.min("title").alias("raw"))
    return reports.missing_references(rows, rows.where("k <> 1"))


_PLACE = {
    "status": "excluded, CASE status WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'in_progress' THEN 3 ELSE 4 END DESC",
    "decision": "excluded, CASE decision WHEN 'fabricated' THEN 0 WHEN 'citation' THEN 1 WHEN 'valid' THEN 2 ELSE 99 END DESC",
    "ref_number": "coalesce(CASE WHEN kind = 3 THEN NULL ELSE ref_number END, 999) DESC",
    "enabled": "CAST(excluded AS INT)",
}


@query(f"""SELECT ref_id, {', '.join(f"CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {o}, CASE WHEN kind = 3 THEN NULL ELSE ref_number END NULLS FIRST, ref_id) AS INT) AS by_{k}" for k, o in _PLACE.items())} FROM (SELECT *, kind % 4 = 0 AS excluded FROM {duck(VERDICTS)})""")
def sort_references(spark, sf_dir):
    """By status and number from the last to the first, by decision and by whether they take part from the first on."""
    out = derived(spark, sf_dir, VERDICTS).withColumns({"excluded": F.col("kind") % 4 == 0, "ref_number": F.when(F.col("kind") != 3, F.col("ref_number"))})
    for key, up in (("status", False), ("decision", True), ("ref_number", False), ("enabled", True)):
        out = curation.sort_references(out, key, up).withColumnRenamed("place", f"by_{key}")
    return out.select("ref_id", *[f"by_{k}" for k in _PLACE])


_DOCS = f"(SELECT doc_id, concat('d', doc_id % 100) AS name, count_if(status = 'in_progress') > 0 AS running, min(kind) > 0 AS searched, min(kind) > 2 AS completed, count_if(status = 'high') AS high FROM {duck(VERDICTS)} GROUP BY doc_id)"
_TIER = "CASE WHEN running THEN 3 WHEN NOT searched THEN 2 WHEN NOT completed THEN 1 ELSE 0 END"


def _documents(spark, sf_dir):
    v = derived(spark, sf_dir, VERDICTS).groupBy("doc_id").agg((F.count_if(F.col("status") == "in_progress") > 0).alias("running"), F.min("kind").alias("k"), F.count_if(F.col("status") == "high").alias("high"))
    return v.select("doc_id", F.concat(F.lit("d"), F.col("doc_id") % 100).alias("name"), "running", (F.col("k") > 0).alias("searched"), (F.col("k") > 2).alias("completed"), "high")


@query(f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {_TIER} DESC, name, doc_id) AS INT) AS by_status, CAST(row_number() OVER (ORDER BY high, name, doc_id) AS INT) AS by_high, CAST(row_number() OVER (ORDER BY CASE WHEN doc_id % 7 = 0 THEN -doc_id END NULLS LAST, name, doc_id) AS INT) AS free FROM {_DOCS}")
def sort_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    order = docs.where("doc_id % 7 = 0").select("doc_id", (-F.col("doc_id")).alias("ord"))
    ranked = store.search_order(docs, by="status", ascending=False).withColumnRenamed("place", "by_status")
    ranked = store.search_order(ranked, by="high").withColumnRenamed("place", "by_high")
    return store.search_order(ranked, order, by="free").select("doc_id", "by_status", "by_high", F.col("place").alias("free"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_TIER} DESC, name, doc_id) AS n FROM {_DOCS}) WHERE n <= 25")
def first_n_documents(spark, sf_dir):
    return store.first_n_documents(_documents(spark, sf_dir), 25, by="status", ascending=False).select("doc_id")


@query(f"SELECT ref_id, concat('c', i) AS cid FROM (SELECT ref_id, kind, i, row_number() OVER (PARTITION BY ref_id ORDER BY (kind * i) % 5 DESC, i) AS n FROM {duck(REFS)} CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)) WHERE n = 1 AND kind % 2 = 0 AND i <> 3")
def pick_enrichment(spark, sf_dir):
    rows = refs(spark, sf_dir).select("ref_id", "kind", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("at"))
    rows = rows.select("ref_id", "at", ((F.col("kind") * F.col("at")) % 5 / 5).alias("overlap"), (F.col("kind") % 2 == 0).alias("scraped_truncated"), F.when(F.col("at") == 3, "").otherwise(F.concat(F.lit("c"), "at")).alias("cid"))
    return curation.pick_enrichment(rows)


@query(f"SELECT ref_id, CASE WHEN kind = 1 THEN 'high' ELSE status END AS status, kind = 2 OR (kind NOT IN (0, 2, 3) AND has_match AND problem <> '') AS any_tag FROM {duck(VERDICTS)}")
def status_overrides(spark, sf_dir):
    """A status set twice (the later wins), one cleared again, and tags raised, lowered and left."""
    v = derived(spark, sf_dir, VERDICTS)
    edits = v.where("kind IN (1, 5)").select("ref_id", F.explode(F.array(F.struct(F.lit(1).alias("ts"), F.lit("low").alias("status")), F.struct(F.lit(2).alias("ts"), F.when(F.col("kind") == 1, "high").alias("status")))).alias("e")).select("ref_id", "e.*")
    raised = F.when(F.col("kind") == 2, F.create_map(F.lit("!title"), F.lit(True))).when(F.col("kind").isin(0, 3), F.map_from_arrays(F.array(*map(F.lit, curation.TAGS)), F.array(*[F.lit(False)] * len(curation.TAGS)))).otherwise(F.create_map().cast("map<string,boolean>"))
    return curation.override_status(v, edits).select("ref_id", "status", curation.any_tag(curation.effective_tags(raised, F.array("problem"), F.col("has_match"))).alias("any_tag"))


@query(f"SELECT ref_id, CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE status END AS status FROM {duck(VERDICTS)} WHERE doc_id % 5 <> 1")
def bulk_status(spark, sf_dir):
    """Approve the references of some documents and delete others."""
    v = derived(spark, sf_dir, VERDICTS)
    docs = v.select("doc_id").distinct()
    return curation.delete_document(curation.bulk_status(v, docs.where("doc_id % 3 = 0"), "approved"), docs.where("doc_id % 5 = 1")).select("ref_id", "status")


@query(f"SELECT ref_id, title AS query FROM {duck(VERDICTS)} WHERE kind IN (0, 7)")
def second_tier_list(spark, sf_dir):
    v = derived(spark, sf_dir, VERDICTS)
    return curation.second_tier_queue(v, F.col("title"), v.where("kind IN (0, 7)"))


@query(f"SELECT ref_id FROM {duck(REFS)} WHERE doc_id % 4 = 1")
def read_reference_subset(spark, sf_dir):
    r = refs(spark, sf_dir)
    return store.read_reference_subset(r, r.where("doc_id % 4 = 1").select("doc_id")).select("ref_id")


MATCHED = f"""SELECT ref_id, doc_id, ref_number, title AS raw, status, problem, kind, named_struct('database', 'crossref', 'title', title, 'authors', array('A'), 'year', year, 'doi', '', 'journal', journal, 'url', url, 'score', CAST(0.5 AS DOUBLE), 'raw_score', CAST(0.5 AS DOUBLE), 'volume', CASE WHEN kind % 2 = 0 THEN '3' ELSE '' END, 'issue', CAST(NULL AS STRING), 'pages', '1-2',
    'publisher', '', 'editors', array('E', 'F'), 'document_type', '', 'language', '', 'issn', CAST(array() AS ARRAY<STRING>), 'isbn', array('9'), 'search_url', 'x') AS m FROM ({VERDICTS}) AS v"""


def _results(spark, sf_dir):
    rows = derived(spark, sf_dir, MATCHED)
    other = F.col("m").withField("database", F.lit("pubmed")).withField("score", F.lit(0.4))
    return rows.withColumns({"best_match": F.when(F.col("kind") != 6, F.col("m")), "all_results": F.when(F.col("kind") != 6, F.array(other, F.col("m"))).otherwise(F.array(other)), "parsed_title": F.when(F.col("kind") == 5, "").otherwise(F.lit("a b")), "scholar_url": F.lit("s"), "google_url": F.lit("g")})


@query(f"""SELECT ref_id, CASE WHEN kind <> 6 THEN 'crossref' END AS best, CASE WHEN kind = 6 OR kind = 5 THEN CASE WHEN kind = 5 THEN '' END ELSE 'https://search.crossref.org/search/works?q=a+b&from_ui=yes' END AS best_url, CASE WHEN kind = 5 THEN '' ELSE 'https://pubmed.ncbi.nlm.nih.gov/?term=a%20b' END AS first_url,
    CASE WHEN kind = 5 THEN '' ELSE 'https://scholar.google.com/scholar?q=a+b' END AS scholar_url, CASE WHEN kind = 6 THEN 1 ELSE 2 END AS n FROM {duck(VERDICTS)}""")
def stored_verifications(spark, sf_dir):
    """Results as they come back from the store, after the documents with even ids were stored unfinished and then replaced."""
    path, rows = new_folder(spark, "verifications"), _results(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    kept = lambda df: df.withColumns({"source_id": F.col("ref_id").cast("string"), "doc_id": F.col("doc_id").cast("string")})
    store.write_verifications(kept(rows.withColumn("all_results", F.when(~even, F.col("all_results")))), path)
    store.write_verifications(kept(rows.where(even)), path)
    back = store.read_verifications(spark, path).withColumn("ref_id", F.col("source_id").cast(rows.schema["ref_id"].dataType))
    return back.select("ref_id", "best_match.database", F.col("best_match.search_url").alias("best_url"), F.col("all_results")[0]["search_url"].alias("first_url"), "scholar_url", F.size("all_results").alias("n")).withColumnRenamed("database", "best")


@query(f"""SELECT ref_id, CASE WHEN kind = 8 THEN 'valid' ELSE decision END AS decision, CASE WHEN kind = 6 THEN '' ELSE concat(CASE WHEN kind % 2 = 0 THEN 'volume=3;' ELSE '' END, 'pages=1-2;editors=E, F;isbn=9') END AS extras FROM {duck(VERDICTS)} WHERE kind <> 4 AND status <> 'in_progress'""")
def report_lines(spark, sf_dir):
    """Reference rows of the report; kind 4 is excluded, rows in progress have no result."""
    _, lines = _report(spark, sf_dir)
    return lines.select("ref_id", "decision", F.coalesce(F.array_join(F.transform("extras", lambda e: F.concat_ws("=", e.key, e.value)), ";"), F.lit("")).alias("extras"))


@query(f"""WITH v AS (SELECT doc_id, status, CASE WHEN kind = 8 THEN 'valid' ELSE decision END AS decision FROM {duck(VERDICTS)} WHERE kind <> 4 AND status <> 'in_progress') SELECT doc_id, {', '.join(f"count_if(status = '{s}') AS {s}" for s in ('high', 'medium', 'low'))}, {', '.join(f"count_if(decision = '{d}') AS {d}" for d in ('valid', 'citation', 'fabricated'))}, count(*) AS total FROM v GROUP BY doc_id""")
def report_header(spark, sf_dir):
    return _report(spark, sf_dir)[0]


def _report(spark, sf_dir):
    rows = _results(spark, sf_dir)
    decided = derived(spark, sf_dir, VERDICTS).select("ref_id", "decision")
    results = rows.where("status <> 'in_progress'").join(decided, "ref_id").select("ref_id", "status", F.array("problem").alias("problem_tags"), "decision", F.when(F.col("kind") == 8, "valid").alias("decision_override"), "best_match")
    return store.report_tables(rows.select("doc_id", "ref_id", "ref_number", "raw", (F.col("kind") == 4).alias("excluded")), results)


@query(f"""SELECT ref_id AS key, path, text FROM (SELECT ref_id, kind, title, unnest(['$.a', '$.list[1].x', '$.skip']) AS path, unnest([0, 1, 2]) AS i FROM {duck(REFS)}) t, LATERAL (SELECT CASE i WHEN 0 THEN concat(title, ' is long enough') WHEN 1 THEN concat('also long enough: ', title) END AS text) WHERE text IS NOT NULL AND (i = 0 OR kind % 2 = 0)""")
def walk_reference_records(spark, sf_dir):
    """Records at two depths, one inside another (not searched), texts that are too short or no strings."""
    inner = F.struct(F.concat(F.lit("also long enough: "), "title").alias("text"))
    tree = F.struct(
        F.struct(F.concat("title", F.lit(" is long enough")).alias("raw_text"), F.struct(F.repeat(F.lit("hidden "), F.lit(9)).alias("text")).alias("child")).alias("a"),
        F.array(F.struct(F.struct(F.lit("short").alias("text")).alias("x")), F.struct(F.when(F.col("kind") % 2 == 0, inner).alias("x"))).alias("list"),
        F.struct(F.lit(12345678901234567890123.0).alias("raw_text")).alias("skip"),
    )
    rows = refs(spark, sf_dir).select("ref_id", F.to_json(tree).alias("json"))
    return store.walk_reference_records(rows, "ref_id", "json").select("key", "path", "text")


# --- labelled data

PIECE = f"""SELECT ref_id, CAST(i AS INT) AS piece, CASE WHEN i IN (0, 7) THEN CAST(NULL AS INT) ELSE CAST(floor((i + 1) / 2.0) - 1 AS INT) END AS word, concat('L', (kind + i) % 4) AS label FROM ({REFS}) AS r CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) AS n"""


@query(f"SELECT ref_id, CAST(w AS INT) AS word, concat('L', (kind + w * 2 + 1) % 4) AS label FROM {duck(REFS)} CROSS JOIN (SELECT unnest([0, 1, 2]) AS w)")
def word_level_predictions(spark, sf_dir):
    """Two pieces a word between two marks."""
    return labels.word_level_predictions(derived(spark, sf_dir, PIECE))


@query(f"""SELECT ref_id, CAST(i AS INT) AS "at", CAST(CASE i WHEN 0 THEN 0 WHEN 1 THEN 11 END AS INT) AS start, CAST(CASE i WHEN 0 THEN 4 WHEN 1 THEN 15 END AS INT) AS "end", CASE i WHEN 2 THEN 'not found' WHEN 3 THEN 'unknown label' END AS error FROM {duck(REFS)} CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i < 2 OR kind = 3""")
def locate_annotations(spark, sf_dir):
    """One word twice (the second annotation takes its second place), then a third time and under an unknown label."""
    rows = refs(spark, sf_dir).withColumn("raw", F.concat(F.lit("deep x and deep: "), "title"))
    tail = F.when(F.col("kind") == 3, F.array(F.struct(F.lit(2).alias("at"), F.lit("deep x").alias("substring"), F.lit("DOI").alias("label")), F.struct(F.lit(3).alias("at"), F.lit("and").alias("substring"), F.lit("NOPE").alias("label")))).otherwise(F.array().cast("array<struct<at:int,substring:string,label:string>>"))
    asked = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("deep ").alias("substring"), F.lit("TITLE").alias("label")), F.struct(F.lit(1).alias("at"), F.lit("deep").alias("substring"), F.lit("JOURNAL").alias("label"))), tail)
    ann = rows.select("ref_id", F.inline(asked))
    return labels.locate_annotations(rows, ann).select("ref_id", "at", "start", "end", "error")


@query(f"""SELECT ref_id, title, CAST(length(title) + 2 AS INT) AS year_at, CAST(CASE WHEN kind % 2 = 0 THEN year ELSE 1987 END AS INT) AS year, concat_ws('-', '5', CASE WHEN kind % 3 > 0 THEN '9' END) AS pages, CASE WHEN kind % 2 = 0 THEN '1234-5678,8765-4321' ELSE '' END AS issn, '10.5/abc' AS doi, 'Keller, A. and Weber' AS people FROM {duck(REFS)}""".replace("'10.5/abc'", "'10.5555/abc'"))
def parsed_from_entities(spark, sf_dir):
    """Entities over a made string of each title: a weak and a strong title, a year cut short, pages, codes, authors in two parts."""
    fixed = " 1987 Keller, A. and Weber 1234-5678 8765-4321 1234-5678 doi:10.5555/abc p. 5 9"
    rows = refs(spark, sf_dir).withColumn("raw", F.concat("title", F.lit("; "), F.when(F.col("kind") % 2 == 0, F.col("year").cast("string")).otherwise("n.d."), F.lit(fixed)))
    n, y = F.length("title"), F.when(F.col("kind") % 2 == 0, 4).otherwise(4)
    base = n + 2 + y
    e = lambda label, start, size, score: F.struct(F.lit(label).alias("label"), start.cast("int").alias("start"), (start + size).cast("int").alias("end"), F.lit(score).alias("score"))
    at = lambda word: base + fixed.index(word)
    entities = [
        e("TITLE", F.lit(0), n, 0.9), e("TITLE", at("Keller"), 6, 0.4), e("AUTHORS", at("Keller"), 10, 0.6), e("AUTHORS", at("Weber"), 5, 0.8), e("PAGE_FIRST", at(" 5 9") + 1, 1, 0.5), e("DOI", at("10.5555"), 11, 0.7),
    ]
    some = F.concat(
        F.array(*entities), F.when(F.col("kind") % 2 == 0, F.array(e("PUBLICATION_YEAR", n + 2, 2, 0.9), e("ISSN", at("1234-5678"), 9, 0.9), e("ISSN", at("8765"), 9, 0.6), e("ISSN", at("8765") + 10, 9, 0.9))).otherwise(F.array(e("ISSN", at("1234-5678"), 9, 0.4))),
        F.when(F.col("kind") % 3 > 0, F.array(e("PAGE_LAST", at(" 5 9") + 3, 1, 0.5))).otherwise(F.array(e("PAGE_LAST", at(" 5 9") + 3, 1, 0.1))),
    )
    out = labels.parsed_from_entities(rows.select("ref_id", F.inline(some)), rows)
    return out.join(rows.select("ref_id", (F.length("title") + 2).alias("year_at")), "ref_id").select("ref_id", "title", "year_at", "year", "pages", F.array_join("issn", ",").alias("issn"), "doi", "people")


@query(f"SELECT ref_id, kind < 6 AS own, md5(concat('42-', ref_id)) AS shuffled FROM {duck(REFS)}")
def concat_training(spark, sf_dir):
    r = refs(spark, sf_dir)
    return labels.concat_training(r.where("kind >= 6").select("ref_id", F.lit(False).alias("own")), r.where("kind < 6").select("ref_id", F.lit(True).alias("own")), "ref_id")


@query(f"""SELECT ref_id, CASE kind % 4 WHEN 0 THEN '10.1234/abc-def' WHEN 1 THEN '10.1234/abc/xy.z' WHEN 2 THEN '10.1234/abc' ELSE '10.1234/x' END AS doi FROM {duck(REFS)}""")
def wrapped_dois(spark, sf_dir):
    """DOIs over line wraps, in each of the three forms."""
    raw = F.when(F.col("kind") % 4 == 0, "see doi: 10.1234/ABC- def. Then").when(F.col("kind") % 4 == 1, "https://doi.org/10.1234/abc/ xy.z)").when(F.col("kind") % 4 == 2, "at 10.1234/abc, next").otherwise("10.9/no doi:10.1234/x.")
    return refs(spark, sf_dir).select("ref_id", identifiers.extract_doi(raw).alias("doi"))


@query(f"SELECT ref_id, cited_work AS arxiv FROM (SELECT ref_id, concat('2101.', 10000 + cited_work, 'v', ref_number) AS cited_work FROM {duck(REFS)})")
def url_arxiv(spark, sf_dir):
    return refs(spark, sf_dir).select("ref_id", identifiers.url_arxiv(F.concat(F.lit("https://arxiv.org/abs/2101."), 10000 + F.col("cited_work"), F.lit("v"), "ref_number")).alias("arxiv"))


# --- ids, approval and small kernels


def _fnv(text: str) -> str:
    """DuckDB: FNV-1a of an ASCII string, as 16 hex digits."""
    start, prime, size = "14695981039346656037::HUGEINT", "1099511628211::HUGEINT", "18446744073709551616::HUGEINT"
    return f"lpad(lower(to_hex(CAST(list_reduce(list_transform(string_split({text}, ''), lambda c: unicode(c)::HUGEINT), lambda h, b: xor(h, b) * {prime} % {size}, {start}) AS UBIGINT))), 16, '0')"


@query(f"SELECT work_id, {_fnv('doc')} AS document_id, concat('d_', left({_fnv('title')}, 12)) AS reference_id FROM (SELECT work_id, concat('c:/papers/', work_id, '.pdf') AS doc, title FROM {duck(CATALOG)})")
def stable_ids(spark, sf_dir):
    path = F.concat(F.lit("C:\\Papers\\"), "work_id", F.lit(".PDF"))
    return catalog(spark, sf_dir).select("work_id", identifiers.document_id(path).alias("document_id"), identifiers.reference_id(F.lit("d"), F.col("title")).alias("reference_id"))


@query(f"SELECT doc_id, min(kind) > 3 AS approved FROM {duck(REFS)} GROUP BY doc_id")
def all_approved(spark, sf_dir):
    return files.all_approved(refs(spark, sf_dir).select("doc_id", F.when(F.col("kind") > 3, "approved").when(F.col("kind") == 1, None).otherwise("edited").alias("status")))


@query(f"SELECT work_id, concat('fi ', title, ' 1⁄2') AS text FROM {duck(CATALOG)}")
def normalize_text(spark, sf_dir):
    """Compatibility forms taken apart, white space collapsed."""
    return catalog(spark, sf_dir).select("work_id", names.nfkd(F.concat(F.lit("ﬁ\u00a0 "), "title", F.lit("\t½ "))).alias("text"))


@query(f"""SELECT work_id, lower(family) AS last_name, concat('the ', lower(title), ' a b fi 1') AS title, CASE work_id % 3 WHEN 0 THEN journal WHEN 1 THEN journal ELSE 'J' END AS journal FROM (SELECT work_id, title, journal, split_part(authors, ',', 1) AS family FROM {duck(CATALOG)})""")
def compare_forms(spark, sf_dir):
    """The forms in which two extractions are compared."""
    form = F.col("work_id") % 4
    family = F.split_part("authors", F.lit(","), F.lit(1))
    name = F.when(form == 0, F.concat(family, F.lit(", A."))).when(form == 1, F.concat(F.lit("Ada "), family)).when(form == 2, F.concat(family, F.lit(" A.B."))).otherwise(F.concat(F.lit(" A. "), family, F.lit(".")))
    tail = F.when(F.col("work_id") % 3 == 0, F.concat("journal", F.lit(", vol. 3, no. 2"))).when(F.col("work_id") % 3 == 1, F.concat("journal", F.lit(" 12(3), 1-9"))).otherwise(F.lit("J, pp. 4"))
    return catalog(spark, sf_dir).select("work_id", compare.compare_last_name(name).alias("last_name"), compare.compare_normalize(F.concat(F.lit("The  "), "title", F.lit(": (A) b! ﬁ ①"))).alias("title"), compare.strip_journal_tail(tail).alias("journal"))


@query(f"SELECT ref_id, round(CAST(CASE WHEN kind % 3 = 0 THEN 0.4 ELSE 0 END + CASE WHEN kind <> 1 THEN 0.15 ELSE 0 END + 0.35 + CASE WHEN journal <> '' THEN 0.1 ELSE 0 END AS DOUBLE), 6) AS sure FROM {duck(REFS)}")
def model_confidence(spark, sf_dir):
    """Confidence in a token model's fields: an arXiv id in place of a DOI, years up to 2099."""
    year = F.when(F.col("kind") == 1, 2100).otherwise(2099)
    arxiv = F.when(F.col("kind") % 3 == 0, "2101.10001")
    out = extract.parse_confidence(F.lit(None).cast("string"), F.col("authors"), year, F.col("title"), F.col("journal"), arxiv, 2099)
    return parsed(spark, sf_dir).select("ref_id", F.round(out, 6).alias("sure"))
