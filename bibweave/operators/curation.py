"""Curation of verification results: exclusions, overrides, queues, merges and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibweave.operators.firsts import without_later

TAGS = ["!title", "!authors", "!year", "!journal", "!doi/arXiv"]


def apply_exclusions(refs: DataFrame, rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """refs (ref_id, raw, url) with excluded, reason, kind. rules: ord, word, reason, kind (``non-doi-url`` for the link rule).

    A true override keeps; then the first word rule found in the lower-cased text, then the link rule (a link, none of them a
    resolver's), then a false override exclude. The rule list is small by nature and becomes one array, so a reference is
    read once whatever the number of rules.
    """
    packed = F.array_sort(F.collect_list(F.struct("ord", "word", "reason", "kind")))
    listed = rules.agg(F.coalesce(packed, F.array()).alias("rules"))
    out = refs.join(F.broadcast(listed))  # one row
    text = F.lower(F.coalesce("raw", F.lit("")))
    word = F.get(F.filter("rules", lambda r: F.coalesce(r.kind != "non-doi-url", F.lit(True)) & F.contains(text, r.word)), F.lit(0))
    link_rule = F.get(F.filter("rules", lambda r: r.kind == "non-doi-url"), F.lit(0))
    links = text.rlike(r"https?://") & ~text.rlike(r"https?://(dx\.)?doi\.org/")
    if overrides is not None:
        out = out.join(overrides.select("ref_id", F.col("enabled").alias("forced")), "ref_id", "left")
    else:
        out = out.withColumn("forced", F.lit(None).cast("boolean"))
    kind = (
        F.when(F.coalesce("forced", F.lit(False)), F.lit(None).cast("string"))
        .when(word.isNotNull(), "word").when(link_rule.isNotNull() & links, "non-doi-url").when(~F.coalesce("forced", F.lit(True)), "user")
    )
    reason = F.when(kind == "word", word["reason"]).when(kind == "non-doi-url", link_rule["reason"])
    return out.select(*refs.columns, kind.isNotNull().alias("excluded"), reason.alias("reason"), kind.alias("kind"))


def not_high(results: DataFrame) -> DataFrame:
    """References to verify again: neither high nor excluded."""
    return results.where((F.coalesce("status", F.lit("")) != "high") & ~F.coalesce("excluded", F.lit(False)))


def second_tier_queue(results: DataFrame, query: Column, only: DataFrame | None = None) -> DataFrame:
    """ref_id, query of the references to search again: low or medium and not excluded, or those of a given list (ref_id)."""
    if only is not None:
        return results.join(only.select("ref_id").distinct(), "ref_id", "left_semi").select("ref_id", query.alias("query"))
    return results.where(F.col("status").isin("low", "medium") & ~F.coalesce("excluded", F.lit(False))).select("ref_id", query.alias("query"))


def effective_decision(tag: dict[str, Column], decision_override: Column, has_match: Column, match_has_journal: Column, match_has_doi: Column) -> Column:
    """The manual decision, else the decision on effective tags; venue and identifier support a citation only where the match
    has them. ``tag`` holds a boolean column for each of TAGS: true where it is raised."""
    ok = {t: ~tag[t] for t in TAGS}
    valid = ok["!authors"] & ok["!year"] & ok["!title"] & ok["!journal"]
    citation = ok["!title"] | (ok["!authors"] & ((ok["!journal"] & match_has_journal) | (ok["!doi/arXiv"] & match_has_doi)))
    return F.coalesce(decision_override, F.when(has_match & valid, "valid").when(has_match & citation, "citation").otherwise("fabricated"))


def effective_tags(overrides: Column, problems: Column, has_match: Column) -> dict[str, Column]:
    """Per tag: its override, else whether it is a problem of a match."""
    return {t: F.coalesce(F.try_element_at(overrides, F.lit(t)), F.array_contains(problems, t) & has_match, F.lit(False)) for t in TAGS}


def any_tag(tags: dict[str, Column]) -> Column:
    """Whether any effective tag is raised."""
    raised = F.lit(False)
    for t in TAGS:
        raised = raised | tags[t]
    return raised


def latest_value(edits: DataFrame, column: str) -> DataFrame:
    """ref_id and the latest value of a log of manual settings (ref_id, ts, column): decisions, statuses. A null clears: no row."""
    last = edits.groupBy("ref_id").agg(F.max(F.struct("ts", column)).alias("e"))
    return last.where(f"e.{column} IS NOT NULL").select("ref_id", f"e.{column}")


def override_status(results: DataFrame, edits: DataFrame) -> DataFrame:
    """results with the status that was set by hand last (edits: ref_id, ts, status)."""
    forced = latest_value(edits, "status").withColumnRenamed("status", "_status")
    return results.join(forced, "ref_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def bulk_status(refs: DataFrame, documents: DataFrame, status: str) -> DataFrame:
    """refs with one status for all references of the given documents (doc_id)."""
    hit = documents.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return refs.join(hit, "doc_id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def delete_document(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of all other documents."""
    return rows.join(documents.select("doc_id"), "doc_id", "left_anti")


def latest_overrides(edits: DataFrame) -> DataFrame:
    """ref_id, overrides map of an edit log (ref_id, tag, value, ts): the latest edit of each tag wins, a null clears."""
    last = edits.groupBy("ref_id", "tag").agg(F.max(F.struct("ts", "value")).alias("e"))
    kept = last.where("e.value IS NOT NULL")
    return kept.groupBy("ref_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", F.col("e.value").alias("value"))))).alias("overrides"))


def merge_edits(refs: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited texts replace detected ones."""
    return refs.join(edits.select("ref_id", F.col("raw").alias("_raw")), "ref_id", "left").withColumn("raw", F.coalesce("_raw", "raw")).drop("_raw")


def merge_snapshots(disk: DataFrame, memory: DataFrame) -> DataFrame:
    """Settled rows in memory win; the other rows on disk stay."""
    settled = memory.where(F.col("status").isin("high", "medium", "low"))
    return disk.join(settled, "ref_id", "left_anti").unionByName(settled)


def prune_results(results: DataFrame, refs: DataFrame) -> DataFrame:
    return results.join(refs.select("ref_id"), "ref_id", "left_semi")


def merge_second_tier(results: DataFrame, scholar: DataFrame) -> DataFrame:
    """All matches of a reference (ref_id, source_db, title, raw_score) with earlier scholar rows replaced by the single best
    new one, ranked again from 1."""
    rows = results.withColumn("_new", F.lit(False)).unionByName(scholar.select(*results.columns, F.lit(True).alias("_new")))
    best = Window.partitionBy("ref_id").orderBy(F.desc("_new"), F.desc("raw_score"), "title")
    rows = rows.withColumns({"_n": F.row_number().over(best), "_searched": F.max("_new").over(Window.partitionBy("ref_id"))})
    rows = rows.where((F.col("_new") & (F.col("_n") == 1)) | (~F.col("_new") & ((F.col("source_db") != "scholar") | ~F.col("_searched"))))
    rank = Window.partitionBy("ref_id").orderBy(F.desc("raw_score"), "source_db", "title")
    return rows.select(*results.columns, F.row_number().over(rank).alias("rank"))


def sort_key(key: str, ascending: bool = True) -> list[Column]:
    """What to order references by (status, ref_number, decision, excluded): excluded ones come last by status and by decision, whatever
    the direction; the decisions' direction is turned around; a reference without a number counts as 999."""
    way = lambda c, up: c.asc() if up else c.desc()
    last = F.coalesce("excluded", F.lit(False)).asc()
    if key == "status":
        return [last, way(sort_rank(F.col("status"), F.lit(False)), ascending)]
    if key == "decision":
        order = F.when(F.col("decision") == "fabricated", 0).when(F.col("decision") == "citation", 1).when(F.col("decision") == "valid", 2).otherwise(99)
        return [last, way(order, not ascending)]
    return [way(F.coalesce("ref_number", F.lit(999)) if key == "ref_number" else F.coalesce("excluded", F.lit(False)).cast("int"), ascending)]


def sort_references(refs: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """refs with ``place`` in each document; equal keys by number and id."""
    order = Window.partitionBy("doc_id").orderBy(*sort_key(key, ascending), "ref_number", "ref_id")
    return refs.withColumn("place", F.row_number().over(order))


def pick_enrichment(candidates: DataFrame) -> DataFrame:
    """ref_id, cid: of each reference's rows (ref_id, at, overlap, scraped_truncated, cid) the one with the largest overlap, of equal
    ones the first, if the page cut it and it has a cid. The rows of a search are made together, so most lesser ones go before the
    rest are dealt."""
    worth = F.when(F.col("scraped_truncated") & (F.col("cid") != ""), F.col("cid"))
    rows = without_later(candidates.select("ref_id", "at", "overlap", worth.alias("cid")), ["ref_id"], {"overlap": "descending", "at": "ascending"})
    best = rows.repartition("ref_id").groupBy("ref_id").agg(F.max_by("cid", F.struct("overlap", -F.col("at"))).alias("cid"))
    return best.where("cid IS NOT NULL")


def sort_rank(status: Column, excluded: Column) -> Column:
    """high < medium < low < in_progress < pending; excluded rows last."""
    order = F.when(status == "high", 0).when(status == "medium", 1).when(status == "low", 2).when(status == "in_progress", 3).otherwise(4)
    return F.when(excluded, 9).otherwise(order)


def search_references(refs: DataFrame, query: str) -> DataFrame:
    """Rows whose number or text holds the query, with rank: exact number, number prefix, number part, text."""
    number, text, q = F.col("ref_number").cast("string"), F.lower("raw"), query.strip().lower()
    rank = F.when(number == q, 0).when(F.startswith(number, F.lit(q)), 1).when(F.contains(number, F.lit(q)), 2).when(F.contains(text, F.lit(q)), 3)
    return refs.withColumn("rank", rank).where("rank IS NOT NULL")


def renumber(refs: DataFrame) -> DataFrame:
    """ref_number by place (page, y) in each document, and suffixes _2, _3 for repeated text ids."""
    place = Window.partitionBy("doc_id").orderBy("page", "y0", "ref_id")
    again = Window.partitionBy("doc_id", "text_id").orderBy("page", "y0", "ref_id")
    suffix = F.row_number().over(again)
    return refs.withColumns({"ref_number": F.row_number().over(place), "source_id": F.concat("doc_id", F.lit("_"), "text_id", F.when(suffix > 1, F.concat(F.lit("_"), suffix)).otherwise(""))})
