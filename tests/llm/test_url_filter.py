import numpy as np
import pytest
from pyspark.sql import functions as F

from bibweave.llm.queries import URL_RULES
from bibweave.llm.url_filter import BlockedBloom, judge_urls

URLS = [
    "http://a.org/", "http://ORG/x", "https://x.example.org/es/1", "https://example.org/en/17?q", "https://example.org/en/27", "http://notexample.org/es/", "http://a.com/fr/1#x", "http://a.com/de/1",
    "http://a.com", "ftp://h.org?x=/", "no scheme/a", "", None, "://org/", "http://u:p@b.org:80/z", "x://y://org/", "http://É.org/ß", "http://a.org/" + "y" * 100_000, "http://" + "a." * 5000 + "com/de/q",
]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [URL_RULES, [*URL_RULES, ("org", "/", "block"), ("com", "", "block"), ("b.org:80", "/z", "allow")], []])
def test_equals_brute_force(spark, rules):
    rows = [(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[0]), (3, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    plain = list({(h, p): (h, p, max(v for a, b, v in rules if (a, b) == (h, p))) for h, p, _ in rules}.values())
    assert sorted(map(tuple, got), key=str) == sorted([(i, *brute(u, plain)) for i, u in rows], key=str)


def test_empty_table(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []


def test_filter_misses_no_key_and_passes_few_others(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bloom = BlockedBloom.of(keys)
    assert bloom.has(np.array([r.h for r in keys.collect()])).all()
    others = spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h"))
    assert bloom.has(np.array([r.h for r in others.collect()])).mean() < 0.02
