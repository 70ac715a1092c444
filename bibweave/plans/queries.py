"""Registered queries for the reference-checking operators, each over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibweave.functions import fuzzy, identifiers, text
from bibweave.functions.sql import register_functions
from bibweave.operators import curation, extract, labels, layout, linkage, reports
from bibweave.plans.derived import ASKED, CATALOG, CROWDED, FEED, LINES, LINES_AT_ONCE, RAW, REFS, STYLED, VERDICTS, catalog, derived, duck, refs, view
from bibweave.streaming import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def raw_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RAW)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VERDICTS)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FEED)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).withColumn("authors", F.split("authors", "; "))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).withColumns({"authors": F.split("authors", "; "), "arxiv": F.lit(None).cast("string")})


# --- text and identifiers

STRIP_NOISE = r"""trim(regexp_replace(regexp_replace(regexp_replace(
    CASE WHEN regexp_matches(raw, '^\s*\[\d{1,3}\]\s*') THEN regexp_replace(raw, '^\s*\[\d{1,3}\]\s*', '')
         WHEN regexp_matches(raw, '^\s*\d{1,3}\.\s+') THEN regexp_replace(raw, '^\s*\d{1,3}\.\s+', '')
         WHEN regexp_matches(raw, '^\s*\d{1,3}\)\s+') THEN regexp_replace(raw, '^\s*\d{1,3}\)\s+', '')
         WHEN regexp_matches(raw, '^\s*\d{1,3}-\s*') THEN regexp_replace(raw, '^\s*\d{1,3}-\s*', '') ELSE raw END,
    '(?i)[,;]?\s*son\s+eri[şs]im\s+tarihi\s*:?\s*\d{1,2}\s+[A-Za-zÇĞİÖŞÜçğıöşü]+\s+\d{4}\.?', ' ', 'g'),
    '(?i)[,;]?\s*eri[şs]im\s+tarihi\s*:?\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\.?', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"""SELECT ref_id, {STRIP_NOISE} AS clean,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({STRIP_NOISE}, 'https?://\\S+', '', 'g'), '(?i)doi[:\\s]*10\\.\\S+', '', 'g'), '10\\.\\d{{4,9}}/\\S+', '', 'g'), '\\s+', ' ', 'g')) AS search_text
    FROM {duck(RAW)}""")
def clean_reference_text(spark, sf_dir):
    rows = raw_refs(spark, sf_dir).select("ref_id", text.strip_noise(F.col("raw")).alias("clean"))
    return rows.withColumn("search_text", text.unlinked(F.col("clean")))


@query(f"""SELECT ref_id, regexp_replace(regexp_replace(regexp_replace(authors, '\\s+&\\s+', ', ', 'g'), '(?i)\\s+and\\s+', ', ', 'g'), '\\s+ve\\s+', ', ', 'g') AS authors,
    CASE WHEN title = '' THEN substr(raw, 1, 200) ELSE title END AS query_text
    FROM (SELECT ref_id, replace(authors, '; ', ' and ') AS authors, title, raw FROM {duck(RAW)})""")
def author_lists_and_query_text(spark, sf_dir):
    joined = F.replace(F.col("authors"), F.lit("; "), F.lit(" and "))
    return raw_refs(spark, sf_dir).select("ref_id", text.author_conjunctions(joined).alias("authors"), text.query_text(F.col("title"), F.col("raw")).alias("query_text"))


_BODY = r"10\.\d{4,9}/[A-Za-z0-9._;()/:+\-]+"


@query(rf"""WITH r AS (SELECT ref_id, raw,
        coalesce(nullif(regexp_extract(raw, '(?i)doi[:\s]+\s*({_BODY})', 1), ''), nullif(regexp_extract(raw, '(?i)https?://(?:dx\.)?doi\.org/({_BODY})', 1), ''), nullif(regexp_extract(raw, '({_BODY})', 1), '')) AS d,
        coalesce(nullif(regexp_extract(raw, '(?i)10\.48550/arxiv\.(\d{{4}}\s*\.\s*\d{{4,5}}(?:v\d+)?)', 1), ''), nullif(regexp_extract(raw, '(?i)arxiv\.org/(?:abs|pdf)/(\d{{4}}\s*\.\s*\d{{4,5}}(?:v\d+)?)', 1), ''), nullif(regexp_extract(raw, '(?i)arxiv[:\s]*(\d{{4}}\s*\.\s*\d{{4,5}}(?:v\d+)?)', 1), '')) AS a
        FROM {duck(RAW)})
    SELECT ref_id, regexp_replace(lower(trim(d)), '[.,;:)\]}}"'']+$', '') AS doi, regexp_replace(a, '\s+', '', 'g') AS arxiv, regexp_replace(regexp_replace(a, '\s+', '', 'g'), 'v\d+$', '') AS arxiv_base FROM r""")
def extract_identifiers(spark, sf_dir):
    doi, arxiv = identifiers.extract_doi(F.col("raw")), identifiers.extract_arxiv(F.col("raw"))
    return raw_refs(spark, sf_dir).select("ref_id", doi.alias("doi"), arxiv.alias("arxiv"), identifiers.arxiv_base(arxiv).alias("arxiv_base"))


@query(f"""SELECT ref_id, coalesce('https://doi.org/' || doi, 'https://arxiv.org/abs/' || arxiv, nullif(url, '')) AS url,
    regexp_extract(coalesce('https://doi.org/' || doi, nullif(url, '')), '^https://doi.org/(10\\..+)$', 1) AS url_doi
    FROM (SELECT ref_id, url, nullif(substr(url, 17), '') AS doi, CASE WHEN ref_number % 2 = 0 THEN concat('2101.0', 1000 + ref_number) END AS arxiv FROM {duck(REFS)})""")
def canonical_urls(spark, sf_dir):
    rows = refs(spark, sf_dir).select("ref_id", "url", F.nullif(F.substr("url", F.lit(17)), F.lit("")).alias("doi"), F.when(F.col("ref_number") % 2 == 0, F.concat(F.lit("2101.0"), 1000 + F.col("ref_number"))).alias("arxiv"))
    url = identifiers.canonical_url(F.col("doi"), F.col("arxiv"), F.col("url"))
    return rows.select("ref_id", url.alias("url"), F.when(url.isNotNull(), F.coalesce(identifiers.url_doi(F.when(F.col("doi").isNotNull() | (F.col("url") != ""), F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), "url"))), F.lit(""))).alias("_d"), F.when(F.col("url") == "", None).otherwise(F.coalesce(identifiers.url_doi(F.col("url")), F.lit(""))).alias("url_doi")).drop("_d")


@query("""SELECT page_id, url <> '' AND url NOT LIKE '%doi.org%' AND url NOT LIKE '%arxiv.org%' AS needs_liveness,
    regexp_matches(url, '^(?i)https?://[^/?#:@]+(:(80|443|8080|8443)?)?([/?#]|$)') AS safe FROM pages""")
def screen_urls(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", text.needs_liveness(F.col("url")).alias("needs_liveness"), text.url_is_safe(F.col("url")).alias("safe"))


@query(f"""SELECT work_id, CASE source_db WHEN 'crossref' THEN concat('https://search.crossref.org/search/works?q=', replace(title, ' ', '+'), '&from_ui=yes')
    WHEN 'openalex' THEN concat('https://openalex.org/works?search=', replace(title, ' ', '%20')) ELSE concat('https://pubmed.ncbi.nlm.nih.gov/?term=', replace(title, ' ', '%20')) END AS search_url
    FROM {duck(CATALOG)}""")
def search_urls(spark, sf_dir):
    return catalog(spark, sf_dir).select("work_id", text.search_url(F.col("source_db"), F.col("title")).alias("search_url"))


@query(f"""SELECT work_id, journal, array_to_string(list_transform(list_filter(regexp_extract_all(journal, '[A-Za-z]+'), lambda w: lower(w) NOT IN ('and','of','the','in','for','on','to','a','an')), lambda w: w[1]), '') AS acronym,
    regexp_replace(regexp_replace(regexp_replace(lower(journal), '^\\s*(in\\s*[:\\-]?\\s*|in\\s+proceedings\\s+of\\s+(the\\s+)?|proceedings\\s+of\\s+(the\\s+)?|the\\s+)', ''), '^ternational', 'ternational'), '\\s+', ' ', 'g') AS canonical
    FROM {duck(CATALOG)}""")
def venue_forms(spark, sf_dir):
    return catalog(spark, sf_dir).select("work_id", "journal", fuzzy.venue_acronym(F.col("journal")).alias("acronym"), fuzzy.canonical_venue(F.col("journal")).alias("canonical"))


@query(f"""WITH t AS (SELECT ref_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS a, regexp_extract_all(lower(raw), '[a-z0-9]+') AS b FROM {duck(RAW)})
    SELECT ref_id, round(len(list_filter(b, lambda x: list_contains(a, x))) / greatest(len(a), len(b)), 6) AS overlap FROM t""")
def title_token_overlap(spark, sf_dir):
    return raw_refs(spark, sf_dir).select("ref_id", F.round(fuzzy.token_overlap(F.col("title"), F.col("raw")), 6).alias("overlap"))


# --- linkage


@query(f"SELECT ref_id, w.work_id FROM {duck(REFS)} r JOIN {duck(CATALOG)} w ON lower(substr(r.url, 17)) = w.doi WHERE r.url <> ''")
def match_by_doi(spark, sf_dir):
    return linkage.match_by_doi(refs(spark, sf_dir), works(spark, sf_dir))


def _keys(sql: str, *keep: str) -> str:
    cols = ", ".join(keep)
    return f"""(SELECT {cols}, unnest(list_distinct(CASE WHEN len(w) > 1 THEN list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) ELSE w END)) AS token FROM (SELECT {cols}, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM {sql}))"""


# All works that share any key compete; weights are whole numbers, so that sums don't depend on their order.
BLOCK = f"""WITH r AS MATERIALIZED (SELECT ref_id AS q, title, year, lower(surname) AS surname FROM {duck(ASKED)}), w AS MATERIALIZED (SELECT * FROM {duck(CROWDED)}),
    t AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY work_id) AS n_keys FROM {_keys("w", "work_id", "source_db", "year", "authors")}),
    df AS (SELECT token, CAST(round(ln(1 + (SELECT count(*) FROM w) / count(*)) * 1000000) AS BIGINT) AS idf FROM t GROUP BY token),
    a AS MATERIALIZED (SELECT k.*, idf FROM {_keys("r", "q", "year", "surname")} k JOIN df USING (token)),
    p AS MATERIALIZED (
        SELECT q, work_id, any_value(source_db) AS source_db, any_value(n_keys) AS n_keys, bool_or(coalesce(abs(t.year - a.year) <= 1, false)) AS near,
               bool_or(list_contains(list_transform(string_split(authors, '; '), lambda x: lower(split_part(x, ',', 1))), surname)) AS same, sum(idf) AS weight
        FROM a JOIN t USING (token) GROUP BY q, work_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY q, source_db ORDER BY weight DESC, same DESC, n_keys, work_id) AS place,
                 row_number() OVER (PARTITION BY q, source_db, near ORDER BY weight DESC, same DESC, n_keys, work_id) AS near_place FROM p)
    SELECT q AS ref_id, source_db, work_id, round(weight / 1000000.0, 6) AS weight FROM b WHERE place <= 5 OR (near AND near_place <= 5)"""


def citations(spark, sf_dir):
    return linkage.distinct_refs(parsed(spark, sf_dir).withColumn("authors", F.array_join("authors", "; "))).withColumn("authors", F.split("authors", "; "))


@query(BLOCK)
def block_by_title(spark, sf_dir):
    """Every distinct title, year and first surname of the references, and invented titles of stock words, against all works."""
    listed = F.split("authors", "; ")
    asked = derived(spark, sf_dir, ASKED).withColumn("authors", F.array(F.concat("surname", F.lit(", X."))))
    return linkage.block_by_title(asked, derived(spark, sf_dir, CROWDED).withColumn("authors", listed)).withColumn("weight", F.round("weight", 6))


@query()
def verify_references(spark, sf_dir):
    return linkage.verify(citations(spark, sf_dir), works(spark, sf_dir))


@query()
def verify_status_rollup(spark, sf_dir):
    """Verification of distinct citations, joined back to every reference and rolled up by document."""
    all_refs = parsed(spark, sf_dir).withColumn("authors", F.array_join("authors", "; "))
    keyed = all_refs.select("ref_id", "doc_id", linkage.citation_key(all_refs).alias("key"))
    found = linkage.verify(citations(spark, sf_dir), works(spark, sf_dir)).withColumnRenamed("ref_id", "key")
    return reports.status_rollup(keyed.join(found, "key"))


@query(f"""SELECT ref_id, work_id, r.year - w.year AS gap, coalesce(substr(r.url, 17) = w.doi AND r.url <> '', false) AS same_identifier
    FROM {duck(REFS)} r JOIN {duck(CATALOG)} w ON r.cited_work = w.work_id""")
def identifier_agreement(spark, sf_dir):
    pairs = refs(spark, sf_dir).select("ref_id", "cited_work", "url", F.col("year").alias("ref_year")).join(catalog(spark, sf_dir).select("work_id", "doi", "year"), F.col("cited_work") == F.col("work_id"))
    none = F.lit(None).cast("string")
    return pairs.select("ref_id", "work_id", (F.col("ref_year") - F.col("year")).alias("gap"), identifiers.identifier_match(F.col("url"), none, F.col("doi"), none, none).alias("same_identifier"))


#: References and works that name each other by link, raw text or field; the last form's raw text names another than its link.
NAMED_BOTH = f"""SELECT ref_id, form, n, m, CASE form WHEN 0 THEN concat('https://doi.org/10.1234/AB', n, '.') WHEN 1 THEN concat('https://arxiv.org/abs/2101.', n, 'v2') WHEN 3 THEN 'https://example.org/x' WHEN 4 THEN concat('http://dx.doi.org/10.5555/ABC', n)
        WHEN 5 THEN concat('https://arxiv.org/abs/2101.', n) END AS url, CASE WHEN form IN (2, 3) THEN concat('A title. arXiv:2101.', n, 'v3') WHEN form = 5 THEN concat('A title. arXiv:2101.', m) ELSE 'A title.' END AS raw,
    CASE WHEN form = 0 THEN concat('doi:10.1234/ab', m) END AS doi, CASE WHEN form IN (3, 5) THEN concat('2101.', m) ELSE '' END AS arxiv,
    CASE form WHEN 1 THEN concat('http://arxiv.org/abs/2101.', m, 'v1') WHEN 2 THEN concat('https://arxiv.org/pdf/2101.', m) WHEN 3 THEN 'https://example.org/x' WHEN 4 THEN concat('https://doi.org/10.5555/abc', m) END AS work_url
    FROM (SELECT ref_id, kind % 6 AS form, 10000 + cited_work AS n, 10000 + cited_work + CASE WHEN ref_number % 4 = 3 OR kind % 6 = 5 THEN 1 ELSE 0 END AS m FROM ({REFS}) AS r) AS f"""


@query(f"SELECT ref_id, form < 5 AND n = m AS same FROM {duck(NAMED_BOTH)}")
def identifier_cases(spark, sf_dir):
    """Links before raw text, fields and links of works, and resolver links on both sides."""
    rows = derived(spark, sf_dir, NAMED_BOTH)
    return rows.select("ref_id", identifiers.identifier_match(*[F.col(c) for c in ("url", "raw", "doi", "arxiv", "work_url")]).alias("same"))


# --- curation

RULES = [(1, "proceedings", "proceedings are checked by hand", None), (2, "unrelated", "off topic", None), (3, None, "links without a DOI", "non-doi-url"), (4, "monographs", "books", None)]


def rules(spark):
    return spark.createDataFrame(RULES, "ord int, word string, reason string, kind string")


@query(f"""WITH r AS (SELECT ref_id, concat(raw, CASE WHEN kind = 11 THEN ' https://host.example/x' ELSE '' END) AS raw, CASE WHEN kind = 3 THEN true WHEN kind = 0 THEN false END AS forced FROM {duck(RAW)}),
    k AS (SELECT *, CASE WHEN forced THEN NULL WHEN contains(lower(raw), 'proceedings') THEN 1 WHEN contains(lower(raw), 'unrelated') THEN 2 WHEN contains(lower(raw), 'monographs') THEN 4
        WHEN regexp_matches(lower(raw), 'https?://') AND NOT regexp_matches(lower(raw), 'https?://(dx\\.)?doi\\.org/') THEN 3 WHEN NOT forced THEN 0 END AS rule FROM r)
    SELECT ref_id, rule IS NOT NULL AS excluded, CASE rule WHEN 1 THEN 'proceedings are checked by hand' WHEN 2 THEN 'off topic' WHEN 3 THEN 'links without a DOI' WHEN 4 THEN 'books' END AS reason,
        CASE WHEN rule IN (1, 2, 4) THEN 'word' WHEN rule = 3 THEN 'non-doi-url' WHEN rule = 0 THEN 'user' END AS kind FROM k""")
def apply_exclusions(spark, sf_dir):
    rows = raw_refs(spark, sf_dir).withColumn("raw", F.concat("raw", F.when(F.col("kind") == 11, " https://host.example/x").otherwise("")))
    forced = rows.where(F.col("kind").isin(0, 3)).select("ref_id", (F.col("kind") == 3).alias("enabled"))
    return curation.apply_exclusions(rows.select("ref_id", "raw"), rules(spark), forced).select("ref_id", "excluded", "reason", "kind")


@query(f"SELECT ref_id FROM {duck(VERDICTS)} WHERE status <> 'high' AND ref_number <> 4")
def not_high(spark, sf_dir):
    return curation.not_high(verdicts(spark, sf_dir).withColumn("excluded", F.col("ref_number") == 4)).select("ref_id")


@query(f"SELECT ref_id, CASE WHEN title = '' THEN url ELSE title END AS query FROM {duck(VERDICTS)} WHERE status IN ('low', 'medium') AND ref_number <> 4")
def second_tier_queue(spark, sf_dir):
    rows = verdicts(spark, sf_dir).withColumn("excluded", F.col("ref_number") == 4)
    return curation.second_tier_queue(rows, F.coalesce(F.nullif("title", F.lit("")), F.col("url")))


@query(f"""WITH v AS (SELECT *, CASE WHEN kind = 4 AND ref_number > 3 THEN false END AS o_title, CASE WHEN kind = 0 AND ref_number = 2 THEN true END AS o_year, CASE WHEN kind = 8 THEN 'valid' END AS forced FROM {duck(VERDICTS)}),
    t AS (SELECT *, coalesce(o_title, problem = '!title' AND has_match) AS b_title, coalesce(o_year, problem = '!year' AND has_match) AS b_year, problem = '!authors' AND has_match AS b_authors, problem = '!journal' AND has_match AS b_journal, problem = '!doi/arXiv' AND has_match AS b_doi FROM v)
    SELECT ref_id, coalesce(forced, CASE WHEN has_match AND NOT b_authors AND NOT b_year AND NOT b_title AND NOT b_journal THEN 'valid'
        WHEN has_match AND (NOT b_title OR (NOT b_authors AND ((NOT b_journal AND match_has_journal) OR (NOT b_doi AND match_has_doi)))) THEN 'citation' ELSE 'fabricated' END) AS decision FROM t""")
def effective_decisions(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    edits = v.where("kind = 4 AND ref_number > 3").select("ref_id", F.lit("!title").alias("tag"), F.lit(False).alias("value"), F.lit(1).alias("ts")).unionByName(
        v.where("kind = 0 AND ref_number = 2").select("ref_id", F.lit("!year").alias("tag"), F.explode(F.array(F.lit(False), F.lit(True))).alias("value")).withColumn("ts", F.col("value").cast("int"))
    )
    rows = v.join(curation.latest_overrides(edits), "ref_id", "left")
    empty = F.create_map().cast("map<string,boolean>")
    tags = curation.effective_tags(F.coalesce("overrides", empty), F.array("problem"), F.col("has_match"))
    forced = F.when(F.col("kind") == 8, "valid")
    return rows.select("ref_id", curation.effective_decision(tags, forced, F.col("has_match"), F.col("match_has_journal"), F.col("match_has_doi")).alias("decision"))


@query(f"""SELECT coalesce(m.ref_id, d.ref_id) AS ref_id, CASE WHEN m.ref_id IS NOT NULL THEN 'high' ELSE d.status END AS status
    FROM {duck(VERDICTS)} d FULL JOIN (SELECT ref_id FROM {duck(VERDICTS)} WHERE kind = 11) m ON d.ref_id = m.ref_id""")
def merge_snapshots(spark, sf_dir):
    v = verdicts(spark, sf_dir).select("ref_id", "status", "kind")
    memory = v.where("kind IN (10, 11)").withColumn("status", F.when(F.col("kind") == 11, "high").otherwise("pending"))
    return curation.merge_snapshots(v.drop("kind"), memory.drop("kind"))


@query(f"SELECT v.ref_id, v.status FROM {duck(VERDICTS)} v WHERE v.kind <> 6")
def prune_results(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    return curation.prune_results(v.select("ref_id", "status"), refs(spark, sf_dir).where("kind <> 6"))


@query(f"SELECT ref_id, CASE WHEN kind = 2 THEN concat(raw, ' (edited)') ELSE raw END AS raw FROM {duck(RAW)}")
def merge_edits(spark, sf_dir):
    rows = raw_refs(spark, sf_dir)
    return curation.merge_edits(rows.select("ref_id", "raw"), rows.where("kind = 2").select("ref_id", F.concat("raw", F.lit(" (edited)")).alias("raw")))


MATCHES = f"""SELECT ref_id, d.source_db, concat(title, d.source_db) AS title, (kind * 37 + length(d.source_db) * 11 + ref_number * 5) % 100 / 100.0 AS raw_score
    FROM {REFS.join(("(", ")"))} r CROSS JOIN (SELECT 'crossref' AS source_db UNION ALL SELECT 'pubmed' UNION ALL SELECT 'scholar') d"""


@query(f"""WITH m AS ({MATCHES.format(part='part', lineitem='lineitem')}), n AS (SELECT ref_id, 'scholar' AS source_db, arg_min(title, (-raw_score, title)) AS title, max(raw_score) AS raw_score FROM
        (SELECT ref_id, concat(title, 'a') AS title, kind / 12.0 AS raw_score FROM {duck(REFS)} WHERE kind > 5 UNION ALL SELECT ref_id, concat(title, 'b'), ref_number / 8.0 FROM {duck(REFS)} WHERE kind > 5) GROUP BY ref_id),
    a AS (SELECT * FROM m WHERE source_db <> 'scholar' OR ref_id NOT IN (SELECT ref_id FROM n) UNION ALL SELECT * FROM n)
    SELECT ref_id, source_db, title, round(raw_score, 4) AS raw_score, row_number() OVER (PARTITION BY ref_id ORDER BY raw_score DESC, source_db, title) AS rank FROM a""")
def merge_second_tier(spark, sf_dir):
    m = derived(spark, sf_dir, MATCHES).withColumn("raw_score", F.col("raw_score").cast("double"))
    r = refs(spark, sf_dir).where("kind > 5")
    new = r.select("ref_id", F.concat("title", F.lit("a")).alias("title"), (F.col("kind") / 12.0).alias("raw_score")).unionByName(r.select("ref_id", F.concat("title", F.lit("b")).alias("title"), (F.col("ref_number") / 8.0).alias("raw_score")))
    return curation.merge_second_tier(m, new.withColumn("source_db", F.lit("scholar"))).select("ref_id", "source_db", "title", F.round("raw_score", 4).alias("raw_score"), "rank")


@query(f"""SELECT ref_id, CASE WHEN ref_number = 4 THEN 9 ELSE CASE status WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'in_progress' THEN 3 ELSE 4 END END AS place,
    CASE status WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS band FROM (SELECT *, CASE kind % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.1 END AS s FROM {duck(VERDICTS)}) WHERE true""".replace("CASE status WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS band", "CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS band"))
def sort_order_and_bands(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    s = F.when(F.col("kind") % 3 == 0, 0.9).when(F.col("kind") % 3 == 1, 0.5).otherwise(0.1)
    return v.select("ref_id", curation.sort_rank(F.col("status"), F.col("ref_number") == 4).alias("place"), linkage.status_band(s).alias("band"))


@query(f"""SELECT ref_id, CASE WHEN ref_number = 2 THEN 0 WHEN contains(lower(raw), '2') THEN 3 END AS rank FROM {duck(RAW)} WHERE ref_number = 2 OR contains(lower(raw), '2')""")
def search_references(spark, sf_dir):
    return curation.search_references(raw_refs(spark, sf_dir), "2").select("ref_id", "rank")


@query(f"""WITH r AS (SELECT *, ref_number % 3 AS page, (kind * 13) % 97 AS y0, concat('t', cited_work % 4) AS text_id FROM {duck(REFS)})
    SELECT ref_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, ref_id) AS ref_number,
    concat(doc_id, '_', text_id, CASE WHEN row_number() OVER (PARTITION BY doc_id, text_id ORDER BY page, y0, ref_id) > 1 THEN concat('_', row_number() OVER (PARTITION BY doc_id, text_id ORDER BY page, y0, ref_id)) ELSE '' END) AS source_id FROM r""")
def renumber_references(spark, sf_dir):
    r = refs(spark, sf_dir).withColumns({"page": F.col("ref_number") % 3, "y0": (F.col("kind") * 13) % 97, "text_id": F.concat(F.lit("t"), F.col("cited_work") % 4)})
    return curation.renumber(r).select("ref_id", "ref_number", "source_id")


# --- reports


@query(f"""SELECT doc_id, count_if(status = 'high') AS high, count_if(status = 'medium') AS medium, count_if(status = 'low') AS low, count_if(status = 'in_progress') AS in_progress, count(*) AS total,
    count_if(status = 'in_progress') = 0 AS completed FROM {duck(VERDICTS)} GROUP BY doc_id""")
def status_rollup(spark, sf_dir):
    return reports.status_rollup(verdicts(spark, sf_dir))


@query(f"""WITH v AS (SELECT doc_id, CASE WHEN kind = 11 THEN CASE WHEN ref_number > 1 THEN 'low' END ELSE status END AS status, CASE WHEN kind = 11 AND ref_number > 1 THEN 'citation' ELSE decision END AS decision, kind = 6 AND ref_number % 2 = 0 AS idle FROM {duck(VERDICTS)})
    SELECT doc_id, count(*) FILTER (status = 'high') AS high, count(*) FILTER (status = 'medium') AS medium, count(*) FILTER (status = 'low') AS low, count(*) FILTER (decision = 'valid' AND status IS NOT NULL) AS valid,
    count(*) FILTER (decision = 'citation' AND status IS NOT NULL) AS citation, count(*) FILTER (decision = 'fabricated' AND status IS NOT NULL AND NOT idle) AS fabricated, count(*) AS total FROM v GROUP BY ROLLUP (doc_id)""")
def decision_rollup(spark, sf_dir):
    """Rows in progress have a prior state but for the first of a document; invented ones of even number were never searched."""
    v = verdicts(spark, sf_dir).withColumn("n_searched", F.when((F.col("kind") == 6) & (F.col("ref_number") % 2 == 0), 0).otherwise(3))
    prior = v.where("ref_number > 1").select("ref_id", F.lit("low").alias("status"), F.lit("citation").alias("decision"), F.lit(True).alias("has_match"), F.lit(3).alias("n_searched"))
    return reports.decision_rollup(v, prior)


OUTCOMES = ["high", "medium", "low", "timeout", "error"]


@query(f"SELECT source_db, {', '.join(f'''count_if(outcome = '{o}') AS {o}''' for o in OUTCOMES)} FROM {duck(FEED)} GROUP BY source_db")
def retrieval_outcomes(spark, sf_dir):
    return reports.retrieval_outcomes(feed(spark, sf_dir), OUTCOMES)


@query(f"SELECT ref_no, array_to_string(list_sort(list(DISTINCT source_db)), ',') AS databases FROM {duck(FEED)} GROUP BY ref_no")
def databases_searched(spark, sf_dir):
    return reports.databases_searched(feed(spark, sf_dir)).select("ref_no", F.array_join("databases", ",").alias("databases"))


@query(f"""WITH s AS (SELECT host, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean FROM {duck(FEED)} GROUP BY host)
    SELECT host, n, {', '.join(f"v[least(CAST(floor(n * {p}) AS BIGINT), n - 1) + 1] AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99))}, round(mean, 6) AS mean FROM s""")
def latency_summary(spark, sf_dir):
    return reports.latency_summary(feed(spark, sf_dir), "value", "host").withColumn("mean", F.round("mean", 6))


@query(f"SELECT host, CAST(ts AS DATE) AS day, count(*) AS used, greatest(0, 60 - count(*)) AS remaining FROM {duck(FEED)} GROUP BY ALL")
def request_budget(spark, sf_dir):
    return reports.request_budget(feed(spark, sf_dir), "host", 60)


@query(f"SELECT host, event_id, n, n > 5 AS over FROM (SELECT host, event_id, count(*) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM {duck(FEED)})")
def trailing_requests(spark, sf_dir):
    return reports.trailing_requests(feed(spark, sf_dir), "host", "event_id", 3600, 5)


@query("SELECT source, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY source")
def bucket_summary(spark, sf_dir):
    return reports.bucket_summary(view(spark, sf_dir, "documents"), "source")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(text, ' ')")
def dedup_first(spark, sf_dir):
    return reports.dedup_first(view(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), ["doc_id"]).select("doc_id", "copies")


@query(f"""WITH a AS (SELECT doc_id, ref_number, min(raw) AS want FROM {duck(RAW)} WHERE kind <> 1 GROUP BY ALL), b AS (SELECT doc_id, ref_number, max(CASE WHEN kind = 4 THEN concat(raw, 'z') ELSE raw END) AS got FROM {duck(RAW)} WHERE kind <> 2 GROUP BY ALL)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count_if(coalesce(want = got, false)) AS equal, count_if(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS matched, count_if(b.doc_id IS NULL) AS missing, count_if(a.doc_id IS NULL) AS extra
    FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.ref_number = b.ref_number GROUP BY ALL""")
def diff_references(spark, sf_dir):
    rows = raw_refs(spark, sf_dir)
    a = rows.where("kind <> 1").groupBy("doc_id", "ref_number").agg(F.min("raw").alias("raw"))
    b = rows.where("kind <> 2").withColumn("raw", F.when(F.col("kind") == 4, F.concat("raw", F.lit("z"))).otherwise(F.col("raw"))).groupBy("doc_id", "ref_number").agg(F.max("raw").alias("raw"))
    return reports.diff_references(a, b)


@query(f"""WITH u AS (SELECT DISTINCT url FROM {duck(REFS)} WHERE url <> ''), p AS (SELECT url, 200 + (length(url) * 37 + ascii(right(url, 1)) * 7) % 300 AS head, 200 + ascii(right(url, 1)) * 11 % 300 AS get FROM u WHERE length(url) % 7 > 0)
    SELECT u.url, coalesce(bool_or(head < 400 OR (head IN (403, 404, 405) AND get < 400)), false) AS alive FROM u LEFT JOIN p USING (url) GROUP BY u.url""")
def attach_liveness(spark, sf_dir):
    u = refs(spark, sf_dir).where("url <> ''").select("url").distinct()
    last = F.ascii(F.right("url", F.lit(1)))
    p = u.where(F.length("url") % 7 > 0).select("url", (200 + (F.length("url") * 37 + last * 7) % 300).alias("head"), (200 + last * 11 % 300).alias("get"))
    return reports.attach_liveness(u, p)


# --- labelled data

SPANS = f"""SELECT ref_id, title AS text, 'TITLE' AS label, 0 AS s, CAST(instr(title, ' for ') - 1 AS INT) AS e, kind, ref_number FROM {REFS.join(("(", ")"))} r WHERE kind NOT IN (6, 9)
    UNION ALL SELECT ref_id, title, 'JOURNAL', CAST(instr(title, ' for ') + 4 AS INT), CAST(length(title) AS INT), kind, ref_number FROM {REFS.join(("(", ")"))} r WHERE kind NOT IN (6, 9)"""


def spans(spark, sf_dir):
    return derived(spark, sf_dir, SPANS).withColumnsRenamed({"s": "start", "e": "end"})


@query(f"""WITH s AS (SELECT ref_id, label, s, e, CASE WHEN kind = 1 THEN e - 1 ELSE e END AS e2, kind FROM {duck(SPANS)}), g AS (SELECT ref_id, label, s, e FROM s WHERE kind <> 2), p AS (SELECT ref_id, label, s, e2 AS e FROM s WHERE kind <> 3),
    b AS (SELECT coalesce(g.label, p.label) AS label, g.ref_id IS NOT NULL AS ing, p.ref_id IS NOT NULL AS inp FROM g FULL JOIN p ON g.ref_id = p.ref_id AND g.label = p.label AND g.s = p.s AND g.e = p.e),
    c AS (SELECT label, count_if(ing AND inp) AS tp, count_if(inp) AS n, count_if(ing) AS support FROM b GROUP BY ROLLUP (label))
    SELECT label, round(tp / n, 6) AS precision, round(tp / support, 6) AS recall, round(2.0 * tp / (n + support), 6) AS f1, support FROM c""")
def ner_scores(spark, sf_dir):
    s = spans(spark, sf_dir)
    pred = s.where("kind <> 3").withColumn("end", F.when(F.col("kind") == 1, F.col("end") - 1).otherwise(F.col("end")))
    out = reports.ner_scores(s.where("kind <> 2"), pred)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


TOKENS = f"""SELECT ref_id, CAST(i AS INT) AS tok, CASE WHEN (kind + i) % 5 = 0 THEN 'O' WHEN (kind * i) % 7 = 1 THEN 'B-TITLE' WHEN (kind + i) % 5 < 3 THEN 'I-TITLE' ELSE 'I-JOURNAL' END AS label, CAST(i * 6 AS INT) AS start_at, CAST(i * 6 + 5 AS INT) AS end_at, (kind + i) % 10 / 10.0 AS score
    FROM {REFS.join(("(", ")"))} r CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) n"""


@query(f"""WITH t AS (SELECT *, regexp_replace(label, '^[BI]-', '') AS kind, lag(regexp_replace(label, '^[BI]-', '')) OVER (PARTITION BY ref_id ORDER BY tok) AS before FROM {duck(TOKENS)}),
    g AS (SELECT *, sum(CASE WHEN label LIKE 'B-%' OR kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id ORDER BY tok) AS island FROM t)
    SELECT ref_id, kind AS label, min(start_at) AS start, max(end_at) AS "end", round(avg(score), 6) AS score FROM g WHERE label <> 'O' GROUP BY ref_id, island, kind""")
def entities_from_bio(spark, sf_dir):
    t = derived(spark, sf_dir, TOKENS).withColumnsRenamed({"start_at": "start", "end_at": "end"}).withColumn("score", F.col("score").cast("double"))
    return labels.entities_from_bio(t).withColumn("score", F.round("score", 6))


TOKEN_SQL = rf"""WITH d AS (SELECT DISTINCT title FROM {duck(REFS)}), t AS (SELECT title, regexp_extract_all(title, '\w+|[^\w\s]') AS w, list_transform(regexp_extract_all(title, '\s*(?:\w+|[^\w\s])'), lambda x: length(x)) AS n FROM d),
    p AS (SELECT title, w, n, unnest(range(len(w))) AS i FROM t)
    SELECT md5(title) AS key, CAST(i AS INT) AS tok, w[i + 1] AS token, CAST(list_sum(n[1:i + 1]) - length(w[i + 1]) AS INT) AS start, CAST(list_sum(n[1:i + 1]) AS INT) AS "end" FROM p"""


@query(TOKEN_SQL)
def word_tokens(spark, sf_dir):
    rows = refs(spark, sf_dir).select("title").distinct().select(F.md5("title").alias("key"), "title")
    return labels.word_tokens(rows, "key", "title").select("key", "tok", "token", "start", "end")


@query(TOKEN_SQL)
def tokens_in_sql(spark, sf_dir):
    """The same by the table function that ``register_functions`` makes known to SQL."""
    register_functions(spark)
    titles = refs(spark, sf_dir).select("title").distinct()
    return spark.sql("SELECT md5(d.title) AS key, t.tok, t.token, t.start, t.`end` FROM {titles} d, LATERAL bib_tokens(d.title) t", titles=titles)


@query(f"""WITH s AS (SELECT ref_id, label, s, e FROM {duck(SPANS)}), t AS (SELECT ref_id, title, unnest(range(len(string_split(title, ' ')))) AS i, string_split(title, ' ') AS w FROM {duck(REFS)} WHERE kind NOT IN (6, 9)),
    o AS (SELECT ref_id, CAST(i AS INT) AS tok, coalesce(list_sum(list_transform(w[1:i], lambda x: length(x) + 1)), 0) AS a, length(w[i + 1]) AS n FROM t),
    h AS (SELECT o.ref_id, tok, label, s, min(tok) OVER (PARTITION BY o.ref_id, label) AS first FROM o JOIN s ON o.ref_id = s.ref_id AND o.a < s.e AND o.a + n > s.s)
    SELECT o.ref_id, o.tok, coalesce(CASE WHEN h.tok = first THEN 'B-' ELSE 'I-' END || label, 'O') AS tag FROM o LEFT JOIN h ON o.ref_id = h.ref_id AND o.tok = h.tok""")
def bio_tags(spark, sf_dir):
    s = spans(spark, sf_dir)
    texts = refs(spark, sf_dir).where("kind NOT IN (6, 9)").select("ref_id", "title")
    return labels.bio_tags(labels.word_tokens(texts, "ref_id", "title").drop("token"), s.drop("text"), "ref_id")


@query(f"""WITH r AS (SELECT ref_id, title, kind, CASE kind WHEN 0 THEN [{{'s': 0, 'e': 4, 'l': 'TITLE'}}, {{'s': 2, 'e': 6, 'l': 'DOI'}}] WHEN 1 THEN [{{'s': 0, 'e': 4, 'l': 'NOPE'}}] WHEN 2 THEN [{{'s': 5, 'e': 500, 'l': 'TITLE'}}] WHEN 3 THEN [] ELSE [{{'s': 0, 'e': 3, 'l': 'TITLE'}}] END AS ents FROM {duck(REFS)})
    SELECT ref_id AS rec_id, CASE kind WHEN 0 THEN 1 WHEN 3 THEN NULL ELSE 0 END AS at, CASE kind WHEN 0 THEN 'overlap' WHEN 1 THEN 'unknown label' WHEN 2 THEN 'out of range' ELSE 'no entities' END AS problem FROM r WHERE kind < 3 OR (kind = 3 AND length(title) > 20)""")
def validate_spans(spark, sf_dir):
    e = lambda a, b, label: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(label).alias("label"))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    ents = F.when(F.col("kind") == 0, F.array(e(0, 4, "TITLE"), e(2, 6, "DOI"))).when(F.col("kind") == 1, F.array(e(0, 4, "NOPE"))).when(F.col("kind") == 2, F.array(e(5, 500, "TITLE"))).when(F.col("kind") == 3, none).otherwise(F.array(e(0, 3, "TITLE")))
    return labels.validate_spans(refs(spark, sf_dir).select(F.col("ref_id").alias("rec_id"), F.col("title").alias("text"), ents.alias("entities")))


@query(f"""WITH g AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42-', doc_id))) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM {duck(REFS)}))
    SELECT ref_id, r.doc_id, CASE WHEN rank <= greatest(1, floor(n * 0.7)) THEN 'train' WHEN rank <= greatest(1, floor(n * 0.7)) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM {duck(REFS)} r JOIN g USING (doc_id)""")
def group_split(spark, sf_dir):
    return labels.group_split(refs(spark, sf_dir).select("ref_id", "doc_id"), "doc_id")


# --- segmentation


def printed_lines(spark, sf_dir):
    return derived(spark, sf_dir, LINES_AT_ONCE)


@query(f"SELECT doc_id, line_no FROM {duck(LINES)} WHERE trim(text) <> '' AND NOT regexp_matches(text, '^\\s*\\d{{1,3}}\\s*$') AND NOT regexp_matches(text, '(?i)^(references|kaynaklar)$')")
def line_filter(spark, sf_dir):
    return layout.line_filter(printed_lines(spark, sf_dir)).select("doc_id", "line_no")


@query(f"""WITH g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, line_no) AS gap FROM {duck(LINES)})
    SELECT doc_id, page, min(CASE WHEN gap >= 0 THEN gap END) AS gap, round(avg(y1 - y0), 6) AS height, min(x0) AS left_edge FROM g GROUP BY doc_id, page""")
def page_baselines(spark, sf_dir):
    return layout.page_baselines(printed_lines(spark, sf_dir)).withColumnRenamed("left", "left_edge").withColumn("height", F.round("height", 6))


@query(f"SELECT doc_id, min(line_no) AS header_line FROM {duck(LINES)} WHERE regexp_matches(text, '(?i)^(references|kaynaklar)$') GROUP BY doc_id")
def find_header(spark, sf_dir):
    return layout.find_header(printed_lines(spark, sf_dir))


#: Numbers of the references of each document: from 1, from 11, falling, in zigzag, from 6.
NUMBERS = f"""SELECT DISTINCT doc_id, ref_number AS line_no, CAST(CASE doc_id % 5 WHEN 0 THEN ref_number WHEN 1 THEN 10 + ref_number WHEN 2 THEN 9 - ref_number WHEN 3 THEN CASE WHEN ref_number % 2 = 0 THEN 4 + ref_number ELSE 12 - ref_number END ELSE 5 + ref_number END AS BIGINT) AS ref_no
    FROM ({REFS}) AS r"""


@query(f"""SELECT doc_id FROM (SELECT *, ref_no - lag(ref_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS step FROM {duck(NUMBERS)})
    GROUP BY doc_id HAVING arg_min(ref_no, line_no) <= 10 AND (count(*) <= 2 OR count(*) FILTER (step > 0) >= count(*) // 3)""")
def valid_splits(spark, sf_dir):
    """Documents whose numbers hold, of five ways to number references."""
    return layout.valid_splits(derived(spark, sf_dir, NUMBERS))


@query(f"""SELECT doc_id, CAST((line_no + 2) // 3 AS BIGINT) AS ref_no, page, greatest(0, min(x0) - 3) AS x0, greatest(0, min(y0) - 3) AS y0, max(x1) + 3 AS x1, max(y1) + 3 AS y1 FROM {duck(LINES)} WHERE line_no > 0 GROUP BY ALL""")
def union_boxes(spark, sf_dir):
    lines = printed_lines(spark, sf_dir).where("line_no > 0").withColumn("ref_no", F.floor((F.col("line_no") + 2) / 3))
    return layout.union_boxes(lines)


@query()
def segment_references(spark, sf_dir):
    return layout.segment_references(printed_lines(spark, sf_dir)).select("doc_id", "ref_no", "raw", F.size("boxes").alias("pages"))


# --- extraction


#: What the printed strings were made of, and so what must be found in them.
PRINTED = f"""SELECT *, ref_number % 3 AS form, split_part(authors, ',', 1) AS family, substr(split_part(authors, ', ', 2), 1, 1) AS initial, CASE WHEN ref_number % 3 < 2 AND url <> '' THEN substr(url, 17) END AS printed_doi,
    CASE WHEN ref_number % 3 = 2 THEN concat('2', right(concat('000', ref_number), 3), '.1', 1000 + ref_number, 'v', ref_number % 3 + 1) END AS printed_arxiv FROM {duck(REFS)}"""


#: A registrant's number in a DOI that reads like a year other than the reference's own is a late year.
LATE = "coalesce(CAST(substr(printed_doi, 4, 4) AS INT) BETWEEN 1900 AND 2099 AND CAST(substr(printed_doi, 4, 4) AS INT) <> year, false)"


@query(f"""SELECT ref_id, CASE form WHEN 1 THEN 'IEEE' WHEN 2 THEN 'Vancouver' ELSE CASE WHEN kind IN (6, 8) THEN 'APA' WHEN {LATE} THEN 'IEEE' END END AS style,
    CAST(CASE form WHEN 1 THEN 0.67 WHEN 2 THEN 0.5 ELSE CASE WHEN kind IN (6, 8) THEN CASE WHEN {LATE} THEN 0.17 ELSE 0.25 END WHEN {LATE} THEN 0.19 ELSE 0 END END AS DOUBLE) AS style_confidence FROM ({PRINTED})""")
def detect_style(spark, sf_dir):
    return extract.detect_style(raw_refs(spark, sf_dir).select("ref_id", "raw")).drop("raw")


@query(f"""SELECT ref_id, title, nullif(journal, '') AS journal, year, CASE form WHEN 0 THEN CASE WHEN kind = 6 THEN authors ELSE split_part(authors, '; ', 1) END WHEN 1 THEN concat(initial, '. ', family, '; B. Co') ELSE concat(family, ' ', initial, '; Co B') END AS authors,
    printed_doi AS doi, printed_arxiv AS arxiv, coalesce('https://doi.org/' || printed_doi, 'https://arxiv.org/abs/' || printed_arxiv) AS url,
    round(CAST(0.5 + CASE WHEN length(journal) >= 3 THEN 0.1 ELSE 0 END + CASE WHEN printed_doi IS NOT NULL THEN 0.4 ELSE 0 END AS DOUBLE), 6) AS parse_confidence FROM ({PRINTED})""")
def parse_references(spark, sf_dir):
    """Every field against what the string was printed from."""
    out = extract.parse_references(raw_refs(spark, sf_dir).select("ref_id", "raw"))
    return out.select("ref_id", "title", "journal", "year", F.array_join("authors", "; ").alias("authors"), "doi", "arxiv", "url", F.round("parse_confidence", 6).alias("parse_confidence"))


@query(f"""SELECT ref_id, t AS title, j AS journal, year, CASE WHEN form IN (0, 3, 6) THEN concat(f1, ', ', g1[1], '.; ', f2, ', ', g2[1], '.')
        WHEN form = 4 THEN concat(f1, ' ', g1[1], '; ', f2, ' ', g2[1]) WHEN form = 5 THEN concat(g1[1], '. ', f1, '; ', g2[1], '. ', f2) ELSE concat(f1, ', ', g1, '; ', g2, ' ', f2) END AS authors FROM {duck(STYLED)}""")
def parse_styles(spark, sf_dir):
    """References printed in six styles; every field must be what it was printed from."""
    out = extract.parse_references(derived(spark, sf_dir, STYLED).select("ref_id", "raw"))
    return out.select("ref_id", "title", "journal", "year", F.array_join("authors", "; ").alias("authors"))


# --- the feed in batch form


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, source_db, outcome, count(*) AS n FROM {duck(FEED)} GROUP BY ALL")
def outcome_rates(spark, sf_dir):
    return feeds.outcome_rates(feed(spark, sf_dir))


@query(f"""WITH w AS (SELECT host, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * unnest([0, 1, 2, 3])) AS start FROM {duck(FEED)})
    SELECT start, host, count(*) AS n, count(*) > 3 AS over FROM w GROUP BY ALL""")
def request_rates(spark, sf_dir):
    return feeds.request_rates(feed(spark, sf_dir), 3)


@query(f"""SELECT ref_no, job_no, ts, event_id, source_db, outcome FROM (SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY job_no DESC, ts DESC, event_id DESC) AS n FROM {duck(FEED)}) WHERE n = 1""")
def latest_progress(spark, sf_dir):
    return feeds.latest_progress(feed(spark, sf_dir))
