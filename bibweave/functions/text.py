"""Cleaning and query columns over raw reference strings."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Numbering prefixes; only the first that matches is removed (fixed patterns).
NUMBERING = [r"^\s*\[\d{1,3}\]\s*", r"^\s*\d{1,3}\.\s+", r"^\s*\d{1,3}\)\s+", r"^\s*\d{1,3}-\s*"]
#: Access-date phrases (fixed patterns).
ACCESS_DATES = [
    r"(?iu)[,;]?\s*son\s+eri[şs]im\s+tarihi\s*:?\s*\d{1,2}\s+[A-Za-zÇĞİÖŞÜçğıöşü]+\s+\d{4}\.?",
    r"(?iu)[,;]?\s*eri[şs]im\s+tarihi\s*:?\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\.?",
]
#: What both phrases hold.
ACCESS = r"(?iu)eri[şs]im\s+tarihi"
#: Search pages: address before and after the encoded title, and whether a blank becomes + (fixed values).
SEARCH_PAGES = {
    "crossref": ("https://search.crossref.org/search/works?q=", "&from_ui=yes", True),
    "scholar": ("https://scholar.google.com/scholar?q=", "", True),
    "google": ("https://www.google.com/search?q=", "", True),
    "openalex": ("https://openalex.org/works?search=", "", False),
    "arxiv": ("https://arxiv.org/search/?query=", "&searchtype=all", False),
    "semantic_scholar": ("https://www.semanticscholar.org/search?q=", "", False),
    "europe_pmc": ("https://europepmc.org/search?query=", "", False),
    "trdizin": ("https://search.trdizin.gov.tr/tr/yayin/ara?q=", "&order=relevance-DESC&page=1&limit=20", False),
    "pubmed": ("https://pubmed.ncbi.nlm.nih.gov/?term=", "", False),
    "openaire": ("https://explore.openaire.eu/search/find?fv0=", "&f0=q", False),
    "open_library": ("https://openlibrary.org/search?q=", "", False),
    "base": ("https://www.base-search.net/Search/Results?lookfor=", "", False),
    "wos": ("https://www.webofscience.com/wos/alldb/basic-search?q=", "", False),
}
KEEPS_COMMAS = "trdizin"  # fixed value


def collapsed(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U) \s+|[^\S ]\s*", " "))  # a single blank is left as it is


@F.arrow_udf(StringType())
def nfkc(column: pa.Array) -> pa.Array:
    """Compatibility forms composed."""
    return pc.utf8_normalize(column, "NFKC")


def strip_noise(col: Column) -> Column:
    """Without the numbering prefix and access dates, blanks collapsed; null is empty."""
    text = F.coalesce(col, F.lit(""))
    bare = dated = F.regexp_replace(text, "|".join(NUMBERING), "")
    for pattern in ACCESS_DATES:
        dated = F.regexp_replace(dated, pattern, " ")
    return collapsed(F.when(text.rlike(ACCESS), dated).otherwise(bare))


def search_text(col: Column) -> Column:
    """strip_noise without links and DOIs."""
    return unlinked(strip_noise(col))


def unlinked(text: Column) -> Column:
    """A clean text without links and DOIs."""
    for pattern in (r"https?://\S+", r"(?i)doi[:\s]*10\.\S+", r"10\.\d{4,9}/\S+"):
        text = F.regexp_replace(text, pattern, "")
    return collapsed(text)


def author_conjunctions(col: Column) -> Column:
    """`` & ``, `` and `` and `` ve `` become commas, in that order."""
    for pattern in (r"\s+&\s+", r"(?i)\s+and\s+", r"\s+ve\s+"):
        col = F.regexp_replace(col, pattern, ", ")
    return col


def query_text(title: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.substring(raw, 1, 200))


def search_url(database: Column, title: Column) -> Column:
    """The search page of a database for a title; empty for an empty title or an unknown database."""
    plus = F.replace(F.replace(F.url_encode(title), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    path = F.replace(F.replace(plus, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    forms = {True: plus, False: F.when(database == KEEPS_COMMAS, F.replace(F.replace(path, F.lit("%2C"), F.lit(",")), F.lit("/"), F.lit("%2F"))).otherwise(path)}
    page = F.try_element_at(F.create_map(*[x for name, (before, after, form) in SEARCH_PAGES.items() for x in (F.lit(name), F.struct(F.lit(before).alias("before"), F.lit(after).alias("after"), F.lit(form).alias("form")))]), database)
    url = F.concat(page["before"], F.when(page["form"], forms[True]).otherwise(forms[False]), page["after"])
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(url, F.lit("")))


def web_searches(title: Column) -> Column:
    """struct<scholar, google>: the general search pages for a title."""
    return F.struct(*[search_url(F.lit(name), title).alias(name) for name in ("scholar", "google")])


def needs_liveness(url: Column) -> Column:
    return (F.coalesce(url, F.lit("")) != "") & ~url.contains("doi.org") & ~url.contains("arxiv.org")


#: IPv4 ranges that are private or reserved: first and last address (fixed values).
RESERVED = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
]
#: IPv6 addresses that are not public: unspecified, loopback, mapped, local, multicast, documentation (fixed patterns).
RESERVED_V6 = r"^(::1?|::ffff:.*|64:ff9b:1:.*|100::.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*)$"


def _address(text: str) -> int:
    return sum(int(x) << 8 * (3 - i) for i, x in enumerate(text.split(".")))


def url_is_safe(url: Column) -> Column:
    """http(s), a host, one of the usual ports, and no literal IP address of a private or reserved range."""
    parts = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i)(https?)://(\[[0-9a-fA-F:.]+\]|[^/?#:@\[\]]+)(?::(\d*))?(?:[/?#]|$)", i)
    octets = [F.regexp_extract(parts(2), r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in (1, 2, 3, 4)]
    number = sum((o.cast("long") * (1 << 8 * (3 - i)) for i, o in enumerate(octets)), F.lit(0).cast("long"))
    reserved = F.lit(False)
    for first, last in RESERVED:
        reserved = reserved | number.between(_address(first), _address(last))
    bad_octet = F.greatest(*octets) > 255
    v6 = F.lower(F.regexp_extract(parts(2), r"^\[(.*)\]$", 1))
    local = F.coalesce(reserved | bad_octet, F.lit(False)) | v6.rlike(RESERVED_V6)
    return (parts(1) != "") & parts(3).isin("", "80", "443", "8080", "8443") & ~local
