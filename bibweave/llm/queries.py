"""The registered queries opN_<name> and their DuckDB counterparts. Each reads its whole table and calls its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibweave.llm import divergence, exact_dedup, jaccard, mixing, mjpeg, packing, prefix_trie, quality, quotations, token_counts, token_shards, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


# The rules that the url query's contract states (fixed values).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, weigh=quality.weight_on(docs, table(spark, sf_dir, "labels")))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    )


def mail_form(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: every turn after the first opens with the turn before it, quoted, and that one's own quote
    of the turn before, quoted twice. The table itself holds no quotes."""
    said = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = lambda n: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.concat(F.lit("> " * n), F.regexp_replace("said", "\n", "\n" + "> " * n), F.lit("\n")).alias(f"quote{n}"))
    return (
        conversations.join(before(1), ["conv_id", "turn"], "left")
        .join(before(2), ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", F.concat(F.coalesce("quote2", F.lit("")), F.coalesce("quote1", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    )


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(mail_form(table(spark, sf_dir, "conversations")))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mjpeg.media_column(table(spark, sf_dir, "documents"))
    shots = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c.first_frame, c.last_frame)), ",")
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.lit("frames="), "n_frames", F.lit(";shots="), shots).alias("feature"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filter, op3_ngram_jaccard, op4_source_mixing, op5_quotation_linking, op6_token_shards, op7_toxicity, op8_exact_dedup, op9_quality, op10_media_mjpeg, op11_source_divergence, op12_prefix_trie, op13_token_counts)}

ORACLES = {
    "op2_url_filter": r"""
        WITH p AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        u AS (SELECT DISTINCT host, path FROM p),
        best AS (
            SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
            FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY host, path)
        SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS terms
            FROM documents),
        w AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS lang_uses FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        u AS (SELECT lang, source, term, count(*) AS uses FROM w GROUP BY ALL),
        c AS (SELECT g.lang, g.source, k.term, coalesce(u.uses, 0) AS uses, k.lang_uses
              FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
        n AS (SELECT lang, source, sum(uses) + 5 * count(*) AS n, sum(lang_uses) + 5 * count(*) AS lang_n FROM c GROUP BY lang, source),
        p AS (SELECT c.lang, c.source, term, uses, 1 + (1000000000::HUGEINT * (uses + 5)) // n::HUGEINT AS p, 1 + (1000000000::HUGEINT * (lang_uses + 5)) // lang_n::HUGEINT AS q
              FROM c JOIN n ON c.lang = n.lang AND c.source = n.source),
        dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE uses > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    # crc32 bit by bit; nodes are named by the list of their turns
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) AS i,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS turns FROM t GROUP BY c),
        h AS (SELECT c, turns, (xor(4294967295::BIGINT, list_reduce(list_transform(range(8 * length(c::VARCHAR)), lambda x: x::BIGINT), lambda a, x: CASE
                    WHEN xor(a, CASE WHEN x % 8 = 0 THEN ascii(substr(c::VARCHAR, (x // 8 + 1)::INTEGER, 1))::BIGINT ELSE 0::BIGINT END) & 1 = 1
                    THEN xor(xor(a, CASE WHEN x % 8 = 0 THEN ascii(substr(c::VARCHAR, (x // 8 + 1)::INTEGER, 1))::BIGINT ELSE 0::BIGINT END) >> 1, 3988292384::BIGINT)
                    ELSE xor(a, CASE WHEN x % 8 = 0 THEN ascii(substr(c::VARCHAR, (x // 8 + 1)::INTEGER, 1))::BIGINT ELSE 0::BIGINT END) >> 1 END, 4294967295::BIGINT)) % 6)::INTEGER AS h FROM o),
        b AS (SELECT h.c, list_concat(coalesce(list_slice(o.turns, 1, h), []), list_slice(h.turns, h + 1, length(h.turns))) AS turns
              FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
        m AS (SELECT c, d, list_slice(turns, 1, d) AS p, d = length(turns) AS ends FROM (SELECT c, turns, unnest(range(length(turns) + 1)) AS d FROM b)),
        n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ids FROM m GROUP BY p, d),
        k AS (SELECT n.*, q.conv_id AS parent_conv_id, count(*) FILTER (q.conv_id IS NOT NULL) OVER (PARTITION BY q.conv_id, q.d) AS siblings, q.d AS pd
              FROM n LEFT JOIN n q ON n.d = q.d + 1 AND list_slice(n.p, 1, n.d - 1) = q.p),
        ch AS (SELECT parent_conv_id, pd, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
        e AS (SELECT k.*, coalesce(n_children, 0) AS n_children, CASE WHEN k.d = 0 THEN 0 ELSE (n_convs - 1) * length(k.p[k.d].text) END AS saved
              FROM k LEFT JOIN ch ON ch.parent_conv_id = k.conv_id AND ch.pd = k.d),
        sub AS (SELECT u.conv_id, u.d, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved_tokens
                FROM e u JOIN e w ON w.d >= u.d JOIN m ON m.c = w.conv_id AND m.d = u.d AND m.p = u.p GROUP BY ALL)
        SELECT e.conv_id, e.d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
               saved_tokens::BIGINT AS saved_tokens, sha256(ids) AS ends_sha256
        FROM e JOIN sub ON sub.conv_id = e.conv_id AND sub.d = e.d""",
}
