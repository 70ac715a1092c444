"""Links in running text: repair over line wraps, the first and the longest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibweave.functions.text import needs_liveness, search_url, url_is_safe

URL_CHARACTERS = r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%\-]"  # fixed pattern
#: A link and the tokens that a line wrap broke off: any after a hyphen; after / _ = ? & one with a separator of its own; never
#: another link. A token with other characters ends it.
WRAPPED_URL = rf"(?i)(https?://\S*(?:(?:(?<=-)\s+(?!https?://)|(?<=[/_=?&])\s+(?!https?://)(?=\S*[./\-_])){URL_CHARACTERS}+(?=\s|$))*)"
URL_END = r"""[.,;:)\]}"']+$"""  # fixed pattern


def urls_in(text: Column) -> Column:
    """All links of a text, repaired, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WRAPPED_URL), 1)
    return F.filter(F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, r"\s+", ""), URL_END, "")), lambda u: u != "")


def repair_url(text: Column) -> Column:
    """The first link, with broken-off parts put back; null without one."""
    return F.get(urls_in(text), F.lit(0))


def best_url(text: Column) -> Column:
    """The longest link; of equally long ones the first."""
    found = urls_in(text)
    longest = F.array_max(F.transform(found, lambda u: F.length(u)))
    return F.get(F.filter(found, lambda u: F.length(u) == longest), F.lit(0))


def preferred_url(entity: Column, text: Column) -> Column:
    """A labelled link, unless the text holds a longer one that begins with it."""
    labelled, whole = repair_url(entity), best_url(text)
    return F.when(labelled.isNull() | (F.startswith(whole, labelled) & (F.length(whole) > F.length(labelled))), whole).otherwise(labelled)


def repair_urls(refs: DataFrame, column: str = "raw") -> DataFrame:
    """ref_id, at, url, needs_liveness, safe, best: one row per reference and link."""
    rows = refs.select("ref_id", F.posexplode(urls_in(F.col(column))).alias("at", "url"), best_url(F.col(column)).alias("_best"))
    return rows.select("ref_id", "at", "url", needs_liveness(F.col("url")).alias("needs_liveness"), url_is_safe(F.col("url")).alias("safe"), (F.col("url") == F.col("_best")).alias("best"))


__all__ = ["best_url", "preferred_url", "repair_url", "repair_urls", "search_url", "urls_in"]
