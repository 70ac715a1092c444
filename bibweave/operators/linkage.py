"""Record linkage: candidates by identifier and by title keys, pair scores, the best match and its decision.

References carry ref_id, title, authors (array), year, journal, url, raw; works carry work_id, source_db, title, authors, year,
journal, doi, arxiv. Missing strings are null or empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibweave.functions.fuzzy import canonical_venue, title_forms, titles_alike, venue_forms, venues_alike
from bibweave.functions.identifiers import arxiv_base, extract_arxiv, identifier_match, normalize_doi, url_arxiv, url_doi
from bibweave.functions.names import author_agreement, family_name
from bibweave.operators.catalog_index import (
    AUTHOR_KEY, CODE_IDF, CONTAINER_KEY, FIELD_LEVELS, HEADS, SCALE, YEAR_KEY, CatalogIndex, build_catalog_index, field_heads, prepared, title_keys,
)
from bibweave.session import not_sent, persisted, spread

HIGH, MEDIUM, TITLE_MATCH, IDENTIFIER_MATCH, VENUE_MATCH = 0.75, 0.50, 0.85, 0.50, 0.75
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.3, 0.7
BONUS = 0.10


def blank(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit("")) == ""


def with_missing(rows: DataFrame, **defaults: Column) -> DataFrame:
    """rows with these columns where it lacks them."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def match_by_doi(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(ref_id, work_id) with equal normalised DOIs."""
    left = refs.select("ref_id", url_doi(F.col("url")).alias("doi"))
    return left.join(works.select("work_id", normalize_doi(F.col("doi")).alias("doi")).where("doi <> ''"), "doi").select("ref_id", "work_id")


def match_by_arxiv(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(ref_id, work_id) with equal arXiv ids, versions aside. A work that the catalog repeats is met once."""
    left = refs.select("ref_id", arxiv_base(extract_arxiv(F.col("url"))).alias("arxiv"))
    held = works.select("work_id", arxiv_base(F.col("arxiv")).alias("arxiv")).where("arxiv <> ''").distinct()
    return left.join(held, "arxiv").select("ref_id", "work_id")


def query_terms(works: DataFrame) -> DataFrame:
    """token, df, idf of the works' title keys; idf is ln(1 + works / df)."""
    n = works.agg(F.count("*").alias("n"))
    df = title_keys(works).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"))  # n is one row


def question(refs: DataFrame) -> DataFrame:
    """ref_id, v (its title), u (title, year and first author's surname), title, ref_year, surname. References of one u are one
    question; what depends on the title alone is done once per v."""
    first = F.lower(family_name(F.get("authors", F.lit(0)))) if "authors" in refs.columns else F.lit("")
    rows = refs.select("ref_id", F.coalesce("title", F.lit("")).alias("title"), F.col("year").alias("ref_year"), F.coalesce(first, F.lit("")).alias("surname"))
    return rows.withColumns({"v": F.xxhash64("title"), "u": F.xxhash64("title", "ref_year", "surname")})


CANDIDATE = ["u", "v", "ref_year", "source_db", "work_id", "near", "weight", "same_author", "n_keys"]


def _lists(found: DataFrame, k: int) -> DataFrame:
    """The candidates among the first k of their question's list, in any year or near it, with their places there."""
    tie = [F.desc("weight"), F.desc("same_author"), "n_keys", "work_id"]
    ranked = found.withColumn("any_rank", F.row_number().over(Window.partitionBy("u", "source_db").orderBy(*tie)))
    ranked = ranked.withColumn("near_rank", F.when(F.col("near"), F.row_number().over(Window.partitionBy("u", "source_db").orderBy(F.desc("near"), *tie))))
    return ranked.where((F.col("any_rank") <= k) | (F.col("near_rank") <= k))


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k candidates of each group by the tie rule, surnames aside."""
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "n_keys", "work_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _reach(lists: DataFrame, k: int, rank: str, *by: str) -> DataFrame:
    """The columns ``by``, reach: the least k-th weight so far of the n questions whose list of this kind is full."""
    return lists.groupBy(*by).agg(F.min(F.when(F.col(rank) == k, F.col("weight"))).alias("reach"), F.count(F.when(F.col(rank) == k, True)).alias("full"))


def block_by_title(refs: DataFrame, works: DataFrame | CatalogIndex, k: int = 5, year_band: int = 1, rounds: tuple[int, ...] = (3,)) -> DataFrame:
    """(ref_id, source_db, work_id, weight): for each reference and database the k works of largest weight, once among those
    within ``year_band`` years of it and once in any year. All works that share a title key compete.

    The weight of a work is the summed idf of the keys it shares with the reference. Ties: works with an author of the first
    author's surname come first, then those with the fewest title keys, then the smallest work_id. ``works`` may be a stored
    index, whose ``heads_kept`` must then be k at least.

    Rare keys are looked up for every title: their works are few by the index's bound. Frequent keys are read from the rarest
    on, by database, and only as far as the keys not yet read could still lift a work into one of the two lists: their summed
    idf is the bound, the k-th weight found so far what it must reach. They lead to classes (works of one database and year
    with the same frequent keys), each met at the first key it shares; a class weighs the same for all its works that share no
    rare key, so its first k works by the tie rule, and the first k of the author's name, stand for it. Pairs thus grow with
    classes, not with works.
    """
    index = works if isinstance(works, CatalogIndex) else build_catalog_index(works, heads=max(k, HEADS))
    if index.heads_kept < k:
        raise ValueError(f"the index keeps {index.heads_kept} works of a class, {k} are asked for")
    asked = persisted(question(refs), "asked")
    variants = persisted(asked.select("u", "v", "ref_year", "surname").distinct(), "variants")
    keys = persisted(title_keys(asked.dropDuplicates(["v"]), "v").select("v", F.xxhash64("token").alias("t")).join(index.table("terms"), "t"), "asked-keys")
    order = Window.partitionBy("v").orderBy("df", "t")
    later = F.sum("idf").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    frequent = keys.where("code IS NOT NULL").withColumns({"place": F.row_number().over(order), "left": later})
    codes = F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x.code)
    hot = persisted(frequent.groupBy("v").agg(codes.alias("asked")), "titles")
    frequent = persisted(frequent.select("v", "t", "place", "left").join(hot, "v"), "frequent")
    dated = variants.where("ref_year IS NOT NULL").groupBy("v", "ref_year").agg(F.count("*").alias("questions"))
    undated = variants.groupBy("v").agg(F.count("*").alias("questions"))
    near = F.coalesce(F.abs(F.col("year") - F.col("ref_year")) <= year_band, F.lit(False))
    shared = lambda held: F.aggregate(F.array_intersect("asked", held), F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(CODE_IDF)))

    rare = keys.where("code IS NULL").join(index.table("postings"), "t").groupBy("v", "work_id").agg(F.sum("idf").alias("rare"))
    rare = rare.join(index.table("info"), "work_id").join(hot.select("v", "asked"), "v", "left")
    rare = rare.withColumn("weight", F.col("rare") + F.coalesce(shared("keys"), F.lit(0))).join(variants, "v")
    lists = persisted(_lists(rare.withColumns({"near": near, "same_author": F.array_contains("surnames", F.col("surname"))}).select(CANDIDATE), k), "found")

    sources = persisted(index.table("class_terms").select("source_db").distinct(), "sources")
    classes, heads = index.table("class_terms"), index.table("heads")
    plain, named, people = heads.where("surname IS NULL").drop("surname"), heads.where("surname IS NOT NULL"), variants.where("surname <> ''")
    done = 0
    for upto in (*rounds, None):
        now = frequent.where(F.col("place") > done if upto is None else (F.col("place") > done) & (F.col("place") <= upto))

        def met(of: DataFrame, rank: str, by: list[str], years: Column | None, now: DataFrame = now, lists: DataFrame = lists) -> DataFrame:
            """Classes that may enter a list, with their weight. A title has a row per database, as many as the catalog has."""
            reach = F.when(F.col("full") == F.col("questions"), F.col("reach")).otherwise(0)
            rows = of.join(sources).join(_reach(lists, k, rank, *by, "source_db"), [*by, "source_db"], "left").withColumn("reach", F.coalesce(reach, F.lit(0)))
            rows = rows.join(now, "v").where("left >= reach").select(*by, "source_db", "reach", "t", "asked", "place", *([F.explode(years).alias("year")] if years is not None else []))
            before = F.slice("asked", F.lit(1), F.col("place") - 1)
            found = rows.join(classes, ["t", "source_db", *(["year"] if years is not None else [])]).where(~F.arrays_overlap(before, "codes"))
            return found.withColumn("weight", shared("codes")).where("weight >= reach").select(*by, "source_db", "year", "cls", "weight")

        close = F.sequence(F.col("ref_year") - year_band, F.col("ref_year") + year_band)
        anywhere, nearby = persisted(met(undated, "any_rank", ["v"], None), "met"), persisted(met(dated, "near_rank", ["v", "ref_year"], close), "met-near")
        # the first k by the title alone and the first k of the surname hold the first k of the question: they are cut before questions
        # of one title are told apart
        mark = lambda rows, is_near, same: rows.withColumns({"near": is_near, "same_author": F.lit(same)}).select(CANDIDATE)
        parts = [
            mark(_first(anywhere.join(plain, "cls"), k, "v", "source_db").join(variants, "v"), near, False),
            mark(_first(anywhere.join(people.select("v", "surname").distinct(), "v").join(named, ["cls", "surname"]), k, "v", "surname", "source_db").join(people, ["v", "surname"]), near, True),
            mark(_first(nearby.join(plain, "cls"), k, "v", "ref_year", "source_db").join(variants, ["v", "ref_year"]), F.lit(True), False),
            mark(_first(nearby.join(people, ["v", "ref_year"]).join(named, ["cls", "surname"]), k, "u", "source_db"), F.lit(True), True),
        ]
        found = persisted(reduce(DataFrame.unionByName, parts), "heads")
        # a head may be known already, with its rare keys: the larger weight is the true one; dealt once, as the lists need it
        best = lists.select(CANDIDATE).unionByName(found).repartition("u", "source_db").groupBy("u", "v", "source_db", "work_id")
        best = best.agg(*[F.max(c).alias(c) for c in ("ref_year", "near", "weight", "same_author", "n_keys")])
        lists = persisted(_lists(best.select(CANDIDATE), k), "found")
        done = upto or done
    return asked.select("ref_id", "u").join(lists, "u").select("ref_id", "source_db", "work_id", (F.col("weight") / float(SCALE)).alias("weight"))


def score_pairs(pairs: DataFrame, refs: DataFrame, works: DataFrame) -> DataFrame:
    """One row per pair: ref_id, work_id, work_source_db, the field scores, raw_score, score, and what ``field_agreement`` finds.
    Two joins fetch the fields, all else is a projection."""
    refs = with_missing(refs, confidence=F.lit(1.0), raw=F.lit(None).cast("string"))
    works = with_missing(works, url=F.lit(None).cast("string"), arxiv=F.lit(None).cast("string"))
    side = lambda df, key, name: df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
    # dealt by reference between the joins, which the second join needs anyway; forms that a side lacks are made after both, as they
    # would double what travels
    rows = spread(pairs.join(not_sent(side(works, "work_id", "work")), "work_id"), "ref_id").join(side(refs, "ref_id", "ref"), "ref_id")
    for s in ("ref", "work"):
        if f"{s}_venue_forms" not in rows.columns:
            plain, tokens = title_forms(F.col(f"{s}_title"))
            rows = rows.withColumns({f"{s}_title_plain": plain, f"{s}_title_tokens": tokens, f"{s}_venue_forms": venue_forms(F.col(f"{s}_journal"))})
    title = titles_alike(*[(F.col(f"{s}_title_plain"), F.col(f"{s}_title_tokens")) for s in ("ref", "work")])
    rows = rows.withColumns(
        {"title_score": title, "venue_score": venues_alike(F.col("ref_venue_forms"), F.col("work_venue_forms")), "authors": author_agreement(F.col("ref_authors"), F.col("work_authors"))}
    )
    gap = F.abs(F.col("ref_year") - F.col("work_year"))
    same_id = identifier_match(F.col("ref_url"), F.col("ref_raw"), F.col("work_doi"), F.col("work_arxiv"), F.col("work_url"))
    own_id = ~blank(url_doi(F.col("ref_url"))) | ~blank(url_arxiv(F.col("ref_url")))
    rows = rows.withColumns(
        {
            "author_score": F.col("authors.score"), "authors_match": F.col("authors.match"), "same_identifier": same_id, "has_identifier": own_id,
            "year_score": F.coalesce(F.when(gap == 0, 1.0).when(gap == 1, 0.5), F.lit(0.0)), "venue_match": ~blank(F.col("ref_journal")) & ~blank(F.col("work_journal")) & (F.col("venue_score") >= VENUE_MATCH),
        }
    )
    titles_only = (F.coalesce("ref_confidence", F.lit(1.0)) < LOW_CONFIDENCE) | (F.coalesce(F.size("ref_authors"), F.lit(0)) <= 0)
    base = F.when(titles_only, F.col("title_score")).otherwise(0.75 * F.col("title_score") + 0.25 * F.col("author_score"))
    extra = lambda c: F.when(c, BONUS).otherwise(0.0)
    raw = F.greatest(F.lit(0.0), base + extra(F.col("year_score") > 0) + extra(F.col("venue_match")) + extra(F.col("has_identifier") & F.col("same_identifier")))
    rows = field_agreement(rows.withColumn("raw_score", F.bround(raw, 4)).withColumn("score", F.least(F.lit(1.0), "raw_score")))
    return rows.select(
        "ref_id", "work_id", "work_source_db", F.bround("title_score", 4).alias("title_score"), "author_score", "year_score", "venue_score", "venue_match", "has_identifier", "same_identifier",
        "raw_score", "score", "title_ok", "authors_ok", "year_ok", "venue_ok", "id_ok",
    )


def best_per_database(scored: DataFrame) -> DataFrame:
    """Of each reference and database the work with the highest clamped score (first by id on ties); zero scores drop out."""
    order = Window.partitionBy("ref_id", "work_source_db").orderBy(F.desc("score"), "work_id")
    rows = scored.where("score > 0").repartition("ref_id")  # for this order and that of ``ranked_databases``
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def ranked_databases(per_database: DataFrame) -> DataFrame:
    """The databases' works of each reference with their rank, by unclamped score."""
    order = Window.partitionBy("ref_id").orderBy(F.desc("raw_score"), "work_source_db", "work_id")
    return per_database.withColumn("rank", F.row_number().over(order))


def best_match(per_database: DataFrame) -> DataFrame:
    """Of each reference the best database's work, by unclamped score."""
    return ranked_databases(per_database).where("rank = 1").drop("rank")


def status_band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def field_agreement(m: DataFrame) -> DataFrame:
    """Booleans title_ok, authors_ok, year_ok, venue_ok, id_ok; a field that both sides lack agrees, years agree up to one apart."""
    either = lambda a, b, same: F.when(blank(F.col(a)) & blank(F.col(b)), True).when(blank(F.col(a)) | blank(F.col(b)), False).otherwise(same)
    has_work_id = ~blank(F.col("work_doi")) | ~blank(F.col("work_arxiv")) | F.coalesce(F.contains("work_url", F.lit("arxiv.org")), F.lit(False))
    years = F.when(F.col("ref_year").isNull() & F.col("work_year").isNull(), True).otherwise(F.coalesce(F.abs(F.col("ref_year") - F.col("work_year")) <= 1, F.lit(False)))
    return m.withColumns(
        {
            "title_ok": F.bround("title_score", 4) >= TITLE_MATCH,
            "authors_ok": F.col("authors_match"),
            "year_ok": years,
            "venue_ok": either("ref_journal", "work_journal", F.col("venue_score") >= VENUE_MATCH),
            "id_ok": F.when(~F.col("has_identifier") & ~has_work_id, True).otherwise(F.col("same_identifier")),
        }
    )


def problem_tags(matched: Column) -> Column:
    """Names of the fields that disagree; none without a match."""
    tags = [("title_ok", "!title"), ("authors_ok", "!authors"), ("year_ok", "!year"), ("venue_ok", "!journal"), ("id_ok", "!doi/arXiv")]
    listed = F.filter(F.array(*[F.when(~F.col(c), tag) for c, tag in tags]), lambda t: t.isNotNull())
    return F.when(matched, listed).otherwise(F.array().cast("array<string>"))


def decision_tag(matched: Column) -> Column:
    ok = {c: F.coalesce(F.col(f"{c}_ok"), F.lit(False)) for c in ("title", "authors", "year", "venue", "id")}
    cited = ok["title"] | (ok["authors"] & (ok["venue"] | ok["id"]))
    return F.when(matched & ok["authors"] & ok["year"] & ok["title"] & ok["venue"], "valid").when(matched & cited, "citation").otherwise("fabricated")


def low_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) < LOW_CONFIDENCE


def high_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) >= HIGH_CONFIDENCE


#: Venue names that tell nothing (fixed values).
GENERIC_VENUES = ["proc", "proceedings", "conference", "conf", "journal", "book"]


def editor_led(raw: Column) -> Column:
    """Whether a reference names editors, so that its authors may not be the work's."""
    return F.lower(F.coalesce(raw, F.lit(""))).rlike(r"\b(?:ed\.|eds\.|editor|editors)\b")  # fixed pattern


def specific_container(journal: Column) -> Column:
    """Whether a venue has six letters and isn't one of the generic ones."""
    letters = F.regexp_replace(F.lower(F.coalesce(journal, F.lit(""))), "[^a-z]", "")
    return (F.length(letters) >= 6) & ~letters.isin(*GENERIC_VENUES)


def usable_keys(refs: DataFrame) -> DataFrame:
    """ref_id, use_author, use_container, use_year: which of the optional keys a reference can be searched by."""
    author = (F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0) & high_confidence(F.col("confidence")) & ~editor_led(F.col("raw"))
    return refs.select("ref_id", author.alias("use_author"), specific_container(F.col("journal")).alias("use_container"), F.col("year").isNotNull().alias("use_year"))


def block_by_fields(refs: DataFrame, works: DataFrame | CatalogIndex, k: int = 5, year_band: int = 1) -> DataFrame:
    """(ref_id, source_db, work_id, levels): works that a reference finds without its title, by its first author's surname, its venue
    and its year (``year_band`` apart at most), for references whose title is ruined or missing.

    A level is a set of two or all of these keys, as bits of a mask; a reference is searched at the levels that its usable keys
    allow (``usable_keys``), and each level gives the first k works of each database, by distance of years, then by work_id;
    ``levels`` counts those that give the work. One key alone says nothing about a work and is no level. The index holds the
    first works of every combination of keys, so a frequent surname in a large journal meets as few as a rare one; references
    of equal keys are one question. ``works`` may be a stored index, whose ``heads_kept`` must be k at least; of plain works only
    these combinations are made, no titles are prepared.
    """
    stored = isinstance(works, CatalogIndex)
    if stored and works.heads_kept < k:
        raise ValueError(f"the index keeps {works.heads_kept} works of a combination, {k} are asked for")
    heads = works.table("fields") if stored else field_heads(works, k)
    refs = with_missing(refs, confidence=F.lit(1.0), raw=F.lit(None).cast("string"), journal=F.lit(None).cast("string"))
    surname, venue = F.lower(family_name(F.get("authors", F.lit(0)))), canonical_venue(F.coalesce("journal", F.lit("")))
    bit = lambda use, value, key: F.when(F.col(use) & (value != ""), key).otherwise(0)
    rows = refs.select("ref_id", F.coalesce(surname, F.lit("")).alias("surname"), venue.alias("venue"), F.col("year").alias("ref_year")).join(usable_keys(refs), "ref_id")
    usable = bit("use_container", F.col("venue"), CONTAINER_KEY) + bit("use_author", F.col("surname"), AUTHOR_KEY) + F.when(F.col("use_year"), YEAR_KEY).otherwise(0)
    rows = rows.select("ref_id", "surname", "venue", "ref_year", usable.alias("usable"))
    asked = persisted(rows.select("ref_id", F.xxhash64("surname", "venue", "ref_year", "usable").alias("q"), "surname", "venue", "ref_year", "usable"), "asked-fields")
    has = lambda key: F.col("level").bitwiseAND(F.lit(key)) > 0
    levels = F.filter(F.array(*map(F.lit, FIELD_LEVELS)), lambda level: level.bitwiseAND(F.col("usable")) == level)
    questions = asked.dropDuplicates(["q"]).withColumn("level", F.explode(levels))
    years = F.when(has(YEAR_KEY), F.sequence(F.col("ref_year") - year_band, F.col("ref_year") + year_band)).otherwise(F.array(F.lit(0)))
    questions = questions.select(
        "q", "ref_year", "level", F.when(has(AUTHOR_KEY), F.col("surname")).otherwise("").alias("surname"), F.when(has(CONTAINER_KEY), F.col("venue")).otherwise("").alias("venue"), F.explode(years).alias("year")
    )
    found = questions.join(heads, ["level", "surname", "venue", "year"])
    gap = F.when(has(YEAR_KEY), F.abs(F.col("year") - F.col("ref_year"))).otherwise(0)
    first = Window.partitionBy("q", "source_db", "level").orderBy("gap", "work_id")
    kept = found.withColumn("gap", gap).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    per_question = kept.groupBy("q", "source_db", "work_id").agg(F.count("*").alias("levels"))
    return asked.select("ref_id", "q").join(per_question, "q").select("ref_id", "source_db", "work_id", "levels")


def relaxation_lattice(candidates: DataFrame, k: int = 5) -> DataFrame:
    """ref_id, source_db, work_id, levels: of candidates (ref_id, source_db, work_id, weight, keys, usable; the two bit masks of the
    keys that agree and of those the reference can be searched by) the best k of every level, a level being a subset of the usable
    keys that a search keeps. One pass over one wide set instead of a search per level; ``levels`` counts those that return a work."""
    # a reference's candidates of all databases travel as one row: with a row per database its id would travel as often
    order = F.struct(F.col("weight").isNull().alias("last"), (-F.col("weight")).alias("minus"), "work_id", "keys", "usable", "source_db")
    whole = candidates.groupBy("ref_id").agg(F.array_sort(F.collect_list(order)).alias("whole"))
    databases = F.array_distinct(F.transform("whole", lambda c: c["source_db"]))
    of = lambda db: F.struct(db.alias("source_db"), F.filter("whole", lambda c: c["source_db"].eqNullSafe(db)).alias("listed"))
    listed = whole.select("ref_id", F.inline(F.transform(databases, of)))
    fits = lambda c, level: (level.bitwiseAND(c["usable"]) == level) & (level.bitwiseAND(c["keys"]) == level)
    best = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda level: F.slice(F.filter("listed", lambda c: fits(c, level)), 1, k))
    works = listed.select("ref_id", "source_db", F.explode(F.transform(F.flatten(best), lambda c: c["work_id"])).alias("work_id"))
    return works.groupBy("ref_id", "source_db", "work_id").agg(F.count("*").alias("levels"))


def first_author_filter(candidates: DataFrame, refs: DataFrame, works: DataFrame) -> DataFrame:
    """Candidates (ref_id, work_id) whose work has an author of the surname of the reference's first author."""
    first = refs.select("ref_id", F.lower(family_name(F.get("authors", F.lit(0)))).alias("surname")).where("surname <> ''")
    held = works.select("work_id", F.transform("authors", lambda a: F.lower(family_name(a))).alias("surnames"))
    return candidates.join(first, "ref_id").join(held, "work_id").where(F.array_contains("surnames", F.col("surname"))).select(*candidates.columns)


def strong_match(score: Column, title_score: Column) -> Column:
    return (score >= 1.0) & (title_score >= TITLE_MATCH)


def match_identifiers(refs: DataFrame, index: CatalogIndex) -> DataFrame:
    """Distinct (ref_id, work_id) with equal DOIs or arXiv ids (of the link, else of the raw text), from the index."""
    refs = with_missing(refs, raw=F.lit(None).cast("string"))
    ident = arxiv_base(F.coalesce(extract_arxiv(F.col("url")), extract_arxiv(F.col("raw"))))
    doi, arxiv = F.struct(F.lit("doi").alias("kind"), url_doi(F.col("url")).alias("ident")), F.struct(F.lit("arxiv").alias("kind"), ident.alias("ident"))
    asked = refs.select("ref_id", F.inline(F.array(doi, arxiv))).where("ident <> ''")
    return asked.join(index.table("identifiers"), ["kind", "ident"]).select("ref_id", "work_id").distinct()


def verify(refs: DataFrame, works: DataFrame | CatalogIndex, k: int = 5) -> DataFrame:
    """One row per reference: ref_id, status, decision, problem_tags, work_id, source_db, score, title_score, strong.

    An identifier's work whose score is below 0.5 is discarded and its reference looked up by title (``block_by_title``); one that
    scores high with no work so far is looked up by author, venue and year too (``block_by_fields``), and the best of all works
    wins. With a stored index nothing of the catalog is read, prepared or counted again; from works, an index is built first.
    raw and confidence are used where refs has them.
    """
    index = works if isinstance(works, CatalogIndex) else build_catalog_index(works, heads=max(k, HEADS))
    refs = persisted(prepared(refs.select("ref_id", "title", "authors", "year", "journal", "url", *[c for c in ("confidence", "raw") if c in refs.columns])), "refs")
    works = index.works
    first = persisted(score_pairs(match_identifiers(refs, index), refs, works), "by_identifier")
    first = first.where(F.col("score") >= IDENTIFIER_MATCH)
    rest = persisted(refs.join(first.select("ref_id").distinct(), "ref_id", "left_anti"), "rest")
    second = persisted(score_pairs(block_by_title(rest, index, k).select("ref_id", "work_id"), rest, works), "by_title")
    open_ = persisted(rest.join(second.where(F.col("score") >= HIGH).select("ref_id").distinct(), "ref_id", "left_anti"), "open")
    more = block_by_fields(open_, index, k).select("ref_id", "work_id").join(second.select("ref_id", "work_id"), ["ref_id", "work_id"], "left_anti")
    third = persisted(score_pairs(more, open_, works), "by_fields")
    best = best_match(best_per_database(first.unionByName(second).unionByName(third)))
    return verdicts(refs.select("ref_id").join(best, "ref_id", "left"))


def verdicts(best: DataFrame) -> DataFrame:
    """Status, decision and tags of references with their best match (columns of ``score_pairs``; nulls where there is none)."""
    matched = F.col("work_id").isNotNull()
    return best.select(
        "ref_id", F.when(matched, status_band(F.col("score"))).otherwise("low").alias("status"), decision_tag(matched).alias("decision"), problem_tags(matched).alias("problem_tags"),
        "work_id", F.col("work_source_db").alias("source_db"), "score", "title_score", F.coalesce(strong_match(F.col("score"), F.col("title_score")), F.lit(False)).alias("strong"),
    )


def second_tier_verdicts(scored: DataFrame, scholar: DataFrame) -> DataFrame:
    """The verdicts of references once a second search is in: both tables hold rows as ``score_pairs`` gives them, ``scholar`` those of
    works found on scholar pages. The best new row replaces a reference's earlier ones from there; the row of highest unclamped
    score is the best match, earlier rows first on ties, and status, tags and decision follow from it anew."""
    rows = scored.select(*scored.columns, F.lit(0).alias("tier")).unionByName(scholar.select(*scored.columns, F.lit(1).alias("tier")))
    # one order tells the first row of all, the first that stays beside new rows, and whether there are any: a reference's rows meet once
    best = Window.partitionBy("ref_id").orderBy(F.desc("raw_score"), "tier", F.when(F.col("tier") == 0, F.col("work_source_db")), "work_id")
    so_far, whole = best.rowsBetween(Window.unboundedPreceding, Window.currentRow), best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stays = (F.col("tier") == 1) | F.coalesce(F.col("work_source_db") != "scholar", F.lit(True))
    replaced = (F.max("tier").over(whole) == 1) & F.col("ref_id").isNotNull()  # rows without an id replace none
    rows = rows.withColumns({"stays": stays, "replaced": replaced, "place": F.row_number().over(best), "place_left": F.count(F.when(stays, True)).over(so_far)})
    first = F.when(F.col("replaced"), F.col("stays") & (F.col("place_left") == 1)).otherwise(F.col("place") == 1)
    return verdicts(rows.where(first).drop("stays", "replaced", "place", "place_left", "tier"))


def distinct_refs(refs: DataFrame) -> DataFrame:
    """References with equal fields share one verification: ref_id becomes the hash of the fields, member ids stay in the
    source table under the same hash (see ``citation_key``)."""
    return refs.select(citation_key(refs).alias("ref_id"), "title", "authors", "year", "journal", "url").dropDuplicates(["ref_id"])


def citation_key(refs: DataFrame) -> Column:
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in ("title", "authors", "year", "journal", "url")]))
