"""Citation tables derived from the driver's tables by key arithmetic, with one SQL text for Spark and DuckDB.

The driver data holds no citations. ``catalog`` has a work per part, ``refs`` a reference per line item that cites its part's
work with a corruption chosen by its keys, ``documents`` are the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibweave.session import not_sent, spread

TOPICS = "adaptive,robust,sparse,bayesian,neural,spectral,causal,stochastic,modular,quantum,recursive,federated,symbolic,latent,convex,temporal"
FIELDS = "retrieval,inference,planning,scheduling,alignment,diffusion,clustering,routing,sampling,parsing,tracking,forecasting,synthesis"
FAMILIES = "Keller,Okafor,Lindqvist,Moreau,Tanaka,Baptista,Novak,Rahman,Silva,Johansson,Petrov,Haddad,Ivanova,Castillo,Weber,Nakamura,Oduya,Fischer,Romano"
GIVEN = "Ada,Boris,Chen,Dana,Elif,Farid,Greta,Hugo,Ines,Jonas,Karim,Lena,Mateo"
VENUES = "Journal of Applied,Transactions on,International Review of,Annals of,Letters in,Proceedings of the Symposium on,Bulletin of"


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', ',', CAST(({index}) % {words.count(',') + 1} + 1 AS INT))"


def _div(column: str, by: int) -> str:
    return f"CAST(floor({column} / {by}.0) AS BIGINT)"


CATALOG = f"""
SELECT p_partkey AS work_id,
       {_pick("crossref,openalex,pubmed", "p_partkey")} AS source_db,
       concat({_pick(TOPICS, "p_partkey")}, ' ', {_pick(FIELDS, _div("p_partkey", 16))}, ' for ', lower(p_name), ' ', {_pick(FIELDS, _div("p_partkey", 7))}, ' series ', p_partkey % 97) AS title,
       concat({_pick(FAMILIES, "p_partkey")}, ', ', {_pick(GIVEN, "p_partkey")}, '; ', {_pick(FAMILIES, _div("p_partkey", 3) + " + 5")}, ', ', {_pick(GIVEN, _div("p_partkey", 5))}) AS authors,
       CAST(1995 + p_partkey % 7 AS INT) AS year,
       concat({_pick(VENUES, "p_partkey")}, ' ', {_pick(FIELDS, "p_partkey")}) AS journal,
       concat('10.', 1000 + p_partkey % 9000, '/p', p_partkey) AS doi
FROM {{part}}"""

REFS = f"""
WITH cited AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS ref_id,
           l_orderkey AS doc_id, l_linenumber AS ref_number, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 12 AS kind, l_suppkey, c.*
    FROM {{lineitem}} JOIN ({CATALOG}) AS c ON l_partkey = work_id)
SELECT ref_id, doc_id, ref_number, CAST(kind AS INT) AS kind, work_id AS cited_work,
       CASE WHEN kind = 6 THEN concat({_pick(TOPICS, "work_id + 3")}, ' ', {_pick(GIVEN, "l_suppkey")}, ' monographs on ', lower({_pick(FAMILIES, "l_suppkey")}), ' ', l_suppkey % 53)
            WHEN kind = 4 THEN concat(substr(title, 1, 5), 'x', substr(title, 7))
            WHEN kind = 9 THEN concat(substr(title, instr(title, ' for ') + 5), ' ', substr(title, 1, instr(title, ' for ') - 1))
            ELSE title END AS title,
       CASE WHEN kind = 6 THEN concat({_pick(FAMILIES, "l_suppkey + 9")}, ', ', substr({_pick(GIVEN, "l_suppkey")}, 1, 1), '.')
            WHEN kind = 3 THEN split_part(authors, '; ', 1)
            WHEN kind = 8 THEN concat({_pick(FAMILIES, "work_id + 7")}, ', Q.')
            ELSE authors END AS authors,
       CAST(CASE WHEN kind = 1 THEN year + 1 WHEN kind = 2 THEN year + 3 ELSE year END AS INT) AS year,
       CASE WHEN kind = 7 THEN 'Gazette of Unrelated Notes' WHEN kind = 10 THEN '' ELSE journal END AS journal,
       CASE WHEN kind IN (5, 6, 9, 11) THEN '' ELSE concat('https://doi.org/', doi) END AS url
FROM cited"""

#: The catalog beside works of stock titles, which share frequent words only; and what is asked of it: every distinct title, year
#: and first surname of the references, and invented titles that share the stock words with all of these works.
CROWDED = f"""
SELECT work_id, source_db, title, authors, year FROM ({CATALOG}) AS c
UNION ALL
SELECT work_id + 100000000 AS work_id, {_pick("crossref,openalex,pubmed,base,trdizin", "work_id")} AS source_db,
       concat({_pick(GIVEN, "work_id")}, ' in the journal of applied studies') AS title, authors, year
FROM ({CATALOG}) AS c"""

ASKED = f"""
SELECT DISTINCT concat_ws('/', title, year, surname) AS ref_id, title, year, surname
FROM (SELECT title, year, split_part(authors, ',', 1) AS surname FROM ({REFS}) AS r
      UNION ALL
      SELECT concat('invented ', l_suppkey, ' matters in the journal of applied studies') AS title, CAST(1995 + l_suppkey % 9 AS INT) AS year, {_pick(FAMILIES, "l_suppkey")} AS surname
      FROM {{lineitem}}) AS a"""

#: One printed string per reference, in one of three styles.
RAW = f"""
SELECT *, CASE ref_number % 3
         WHEN 0 THEN concat('[', ref_number, '] ', split_part(authors, '; ', 1), ' (', year, '). ', title, '. ', journal, '. ', url)
         WHEN 1 THEN concat(ref_number, '. ', substr(split_part(authors, ', ', 2), 1, 1), '. ', split_part(authors, ',', 1), ' and B. Co, "', title, '," ', journal, ', vol. ', ref_number, ', pp. 1-9, ', year, '. ', CASE WHEN url = '' THEN '' ELSE concat('doi: ', substr(url, 17)) END)
         ELSE concat(split_part(authors, ',', 1), ' ', substr(split_part(authors, ', ', 2), 1, 1), ', Co B. ', title, '. ', journal, '. ', year, ';', ref_number, ':1-9. arXiv:2', substr(concat('000', ref_number), -3), '. 1', 1000 + ref_number, 'v', ref_number % 3 + 1, ' Erişim tarihi: 1.2.2020') END AS raw
FROM ({REFS}) AS r"""

#: The references printed in the six styles: titles that open with a capital or an article, lists with "and", pages that read like
#: years, a venue with a year in its name. Two Harvard forms and two Chicago forms.
STYLED = f"""
WITH p AS (
    SELECT ref_id, ref_number, CAST((ref_number + doc_id) % 8 AS INT) AS form, year, {_pick(FAMILIES, "cited_work")} AS f1, {_pick(GIVEN, "cited_work")} AS g1,
           {_pick(FAMILIES, "cited_work + 5")} AS f2, {_pick(GIVEN, "cited_work + 4")} AS g2,
           concat({_pick("A,On,The,Towards,An,Why", "cited_work")}, ' ', title) AS t,
           CASE WHEN cited_work % 4 = 0 THEN concat('Proceedings of the 2003 Symposium on ', {_pick(FIELDS, "cited_work")}) ELSE concat({_pick(VENUES, "cited_work")}, ' ', {_pick(FIELDS, "cited_work")}) END AS j,
           3 + cited_work % 40 AS v, 1 + ref_number % 9 AS i, 1950 + cited_work % 30 AS a, 1985 + cited_work % 50 AS z
    FROM ({REFS}) AS r)
SELECT p.*, CASE form
    WHEN 0 THEN concat(f1, ', ', substr(g1, 1, 1), '., & ', f2, ', ', substr(g2, 1, 1), '. (', year, '). ', t, '. ', j, ', ', v, '(', i, '), ', a, '-', z, '.')
    WHEN 1 THEN concat(f1, ', ', g1, ', and ', g2, ' ', f2, '. "', t, '." ', j, ', vol. ', v, ', no. ', i, ', ', year, ', pp. ', a, '-', z, '.')
    WHEN 2 THEN concat(f1, ', ', g1, ', and ', g2, ' ', f2, '. "', t, '." ', j, ' ', v, ', no. ', i, ' (', year, '): ', a, '-', z, '.')
    WHEN 3 THEN concat(f1, ', ', substr(g1, 1, 1), '. and ', f2, ', ', substr(g2, 1, 1), '., ', year, '. ', t, '. ', j, ', ', v, '(', i, '), pp.', a, '-', z, '.')
    WHEN 4 THEN concat(f1, ' ', substr(g1, 1, 1), ', ', f2, ' ', substr(g2, 1, 1), '. ', t, '. ', j, '. ', year, ';', v, ':', a, '-', z, '.')
    WHEN 5 THEN concat(substr(g1, 1, 1), '. ', f1, ' and ', substr(g2, 1, 1), '. ', f2, ', "', t, '," ', j, ', vol. ', v, ', no. ', i, ', pp. ', a, '-', z, ', May ', year, '.')
    WHEN 6 THEN concat(f1, ', ', substr(g1, 1, 1), '., ', f2, ', ', substr(g2, 1, 1), '. ', year, '. ', t, '. ', j, ' ', v, ', pp. ', a, '-', z, '.')
    ELSE concat(f1, ', ', g1, ', and ', g2, ' ', f2, '. ', year, '. "', t, '." ', j, ' ', v, ', no. ', i, ': ', a, '-', z, '.') END AS raw
FROM p"""

#: A verdict per reference, by key arithmetic, for the curation and report jobs.
VERDICTS = f"""
SELECT ref_id, doc_id, ref_number, title, journal, year, url,
       CASE WHEN kind IN (0, 1, 3, 5) THEN 'high' WHEN kind IN (2, 4, 7, 9) THEN 'medium' WHEN kind = 11 THEN 'in_progress' ELSE 'low' END AS status,
       CASE WHEN kind IN (0, 5) THEN 'valid' WHEN kind IN (1, 2, 3, 4, 7, 9) THEN 'citation' ELSE 'fabricated' END AS decision,
       CASE WHEN kind IN (1, 2) THEN '!year' WHEN kind IN (3, 8) THEN '!authors' WHEN kind IN (4, 6) THEN '!title' WHEN kind IN (7, 10) THEN '!journal' WHEN kind = 9 THEN '!doi/arXiv' ELSE '' END AS problem,
       kind <> 6 AS has_match, cited_work % 5 > 0 AS match_has_journal, cited_work % 3 > 0 AS match_has_doi, kind
FROM ({REFS}) AS r"""

#: Events as the verification's progress feed and request log.
FEED = """
SELECT event_id, ts, user_id % 11 AS host, concat('db', user_id % 11) AS source_db, user_id % 97 AS ref_no, event_id % 7 AS job_no, value,
       CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' WHEN 'signup' THEN 'timeout' ELSE 'error' END AS outcome
FROM {events}"""


#: Printed lines of each document: a header, then two lines per reference, numbered in two documents of three.
LINES = f"""
WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ref_number, ref_id) AS n, title, journal, year, kind FROM ({REFS}) AS f),
l AS (SELECT DISTINCT doc_id, 0 AS line_no, CASE WHEN doc_id % 5 = 0 THEN 'Kaynaklar' ELSE 'References' END AS text, 50 AS x0, 0 AS gaps FROM r
    UNION ALL SELECT doc_id, n * 3 - 2, concat(CASE WHEN doc_id % 3 > 0 THEN concat('[', n, '] ') ELSE '' END, substr(title, 1, 20), CASE WHEN kind = 2 THEN '-' ELSE '' END), 50, n FROM r
    UNION ALL SELECT doc_id, n * 3 - 1, concat(substr(title, 21), '. ', journal, ' ', year), 62, n FROM r
    UNION ALL SELECT doc_id, n * 3, CASE WHEN n % 4 = 0 THEN ' 17 ' ELSE '' END, 50, n FROM r)
SELECT doc_id, CAST(floor(line_no / 12.0) + 1 AS INT) AS page, CAST(line_no AS INT) AS line_no, text, CAST(x0 AS DOUBLE) AS x0, CAST(line_no % 12 * 12 + gaps % 12 * 9 AS DOUBLE) AS y0,
       CAST(x0 + length(text) * 5 AS DOUBLE) AS x1, CAST(line_no % 12 * 12 + gaps % 12 * 9 + 10 AS DOUBLE) AS y1 FROM l"""

#: The same lines for Spark, from one pass over the references: Spark would join and number them anew in every branch of the union.
LINES_AT_ONCE = f"""
WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ref_number, ref_id) AS n, title, journal, year, kind FROM ({REFS}) AS f),
l AS (SELECT doc_id, inline(filter(array(
        named_struct('line_no', CASE WHEN n = 1 THEN 0 ELSE -1 END, 'text', CASE WHEN doc_id % 5 = 0 THEN 'Kaynaklar' ELSE 'References' END, 'x0', 50, 'gaps', 0),
        named_struct('line_no', n * 3 - 2, 'text', concat(CASE WHEN doc_id % 3 > 0 THEN concat('[', n, '] ') ELSE '' END, substr(title, 1, 20), CASE WHEN kind = 2 THEN '-' ELSE '' END), 'x0', 50, 'gaps', n),
        named_struct('line_no', n * 3 - 1, 'text', concat(substr(title, 21), '. ', journal, ' ', year), 'x0', 62, 'gaps', n),
        named_struct('line_no', n * 3, 'text', CASE WHEN n % 4 = 0 THEN ' 17 ' ELSE '' END, 'x0', 50, 'gaps', n)), s -> s.line_no >= 0)) FROM r)
SELECT doc_id, CAST(floor(line_no / 12.0) + 1 AS INT) AS page, CAST(line_no AS INT) AS line_no, text, CAST(x0 AS DOUBLE) AS x0, CAST(line_no % 12 * 12 + gaps % 12 * 9 AS DOUBLE) AS y0,
       CAST(x0 + length(text) * 5 AS DOUBLE) AS x1, CAST(line_no % 12 * 12 + gaps % 12 * 9 + 10 AS DOUBLE) AS y1 FROM l"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The table, dealt over the shuffle partitions by a key where its file has fewer splits than there are cores (a file of one
    row group is one split, however large)."""
    table = view(spark, sf_dir, name)
    return table if table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else spread(table, key)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of parts: the works made of it are wider than Spark expects."""
    return not_sent(view(spark, sf_dir, "part"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOG, part=parts(spark, sf_dir))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REFS, part=parts(spark, sf_dir), lineitem=dealt(spark, sf_dir, "lineitem", "l_orderkey"))


CATALOG_DUCK = CATALOG.format(part="part")
REFS_DUCK = REFS.format(part="part", lineitem="lineitem")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    read = {"lineitem": lambda: dealt(spark, sf_dir, "lineitem", "l_orderkey"), "part": lambda: parts(spark, sf_dir)}
    tables = {t: read.get(t, lambda t=t: view(spark, sf_dir, t))() for t in ("part", "lineitem", "events", "documents") if "{" + t + "}" in text}
    return spark.sql(text, **tables)


def duck(text: str) -> str:
    """The same text for DuckDB, as a subquery."""
    return "(" + text.format(part="part", lineitem="lineitem", events="events", documents="documents") + ")"
