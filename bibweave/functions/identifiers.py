"""DOI and arXiv identifiers as columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BODY = r"10\.\d{4,9}/[A-Za-z0-9._;()/:+\-]+"  # fixed pattern
#: A body that ends in - or / takes one more token after a line wrap.
WRAPPED = rf"({BODY}(?:(?<=[-/])\s+[A-Za-z0-9._;()/:+\-]+)?)"
#: The number is taken whole, however long: cut short, it would name another paper.
ARXIV = r"(\d{4}\s*\.\s*\d{4,}(?:v\d+)?)"


def found(col: Column, pattern: str) -> Column:
    """The first group of the first match, null without one. In an array, as nullif would run the pattern twice."""
    return F.get(F.array_remove(F.array(F.regexp_extract(col, pattern, 1)), F.lit("")), F.lit(0))


def normalize_doi(col: Column) -> Column:
    doi = F.lower(F.trim(col))
    for pattern in (r"^https?://(?:dx\.)?doi\.org/", r"^doi:\s*", r"\s+", r"""[.,;:)\]}"']+$"""):
        doi = F.regexp_replace(doi, pattern, "")
    return doi


def extract_doi(col: Column) -> Column:
    """Prefixed, then linked, then bare; null without any."""
    return normalize_doi(F.coalesce(found(col, rf"(?i)doi[:\s]+\s*{WRAPPED}"), found(col, rf"(?i)https?://(?:dx\.)?doi\.org/{WRAPPED}"), found(col, WRAPPED)))


def extract_arxiv(col: Column) -> Column:
    """By the DOI alias, then by link, then bare; inner blanks removed."""
    hit = F.coalesce(*[found(col, rf"(?i){before}{ARXIV}") for before in (r"10\.48550/arxiv\.", r"arxiv\.org/(?:abs|pdf)/", r"arxiv[:\s]*")])
    return F.regexp_replace(hit, r"\s+", "")


def arxiv_base(col: Column) -> Column:
    return F.regexp_replace(col, r"v\d+$", "")


def url_doi(url: Column) -> Column:
    return normalize_doi(found(url, r"^(?i)https?://(?:dx\.)?doi\.org/(10\..+)$"))


def url_arxiv(url: Column) -> Column:
    return found(url, r"^(?i)https?://arxiv\.org/abs/(.+)$")


def canonical_url(doi: Column, arxiv: Column, url: Column) -> Column:
    """A resolver link before an arXiv link before the url itself."""
    return F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://arxiv.org/abs/"), arxiv), F.nullif(url, F.lit("")))


def held_arxiv(url: Column, arxiv: Column) -> Column:
    """A work's arXiv id: from its link, else its own field."""
    return F.coalesce(extract_arxiv(url), F.nullif(arxiv, F.lit("")))


def identifier_match(ref_url: Column, raw: Column, work_doi: Column, work_arxiv: Column, work_url: Column) -> Column:
    """Whether a reference and a work name the same thing: the DOI in the reference's link is the work's; or the arXiv id in the
    reference's link, else in its raw text, is the one in the work's link, else the work's own, versions aside; or both link to
    the resolver with one DOI."""
    same = lambda a, b: F.coalesce((a != "") & (a == b), F.lit(False))
    resolver = lambda url: F.when(F.contains(url, F.lit("doi.org")), normalize_doi(url))
    arxiv = arxiv_base(F.coalesce(extract_arxiv(ref_url), extract_arxiv(raw)))
    return same(url_doi(ref_url), normalize_doi(work_doi)) | same(arxiv, arxiv_base(held_arxiv(work_url, work_arxiv))) | same(resolver(ref_url), resolver(work_url))


#: FNV-1a, 64 bit: offset basis and prime (fixed values).
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(text: str) -> str:
    h = FNV_BASIS
    for byte in text.encode():
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@F.arrow_udf(StringType())
def fnv_hex(column: pa.Array) -> pa.Array:
    """The 64-bit FNV-1a hash of the UTF-8 bytes as 16 hex digits."""
    return pa.array([None if x is None else fnv1a(x) for x in column.to_pylist()], pa.string())


def document_id(path: Column) -> Column:
    """A document's id: the hash of its path, lower-cased, with slashes."""
    return fnv_hex(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))


def reference_id(doc_id: Column, clean: Column) -> Column:
    """A reference's id before suffixes: its document's and the first 12 digits of its clean text's hash."""
    return F.concat(doc_id, F.lit("_"), F.substring(fnv_hex(clean), 1, 12))
