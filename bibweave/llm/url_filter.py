"""URL filter: a blocked Bloom filter of the listed keys passes possible hits to an exact hash join.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's path; the longest
host + path wins (then the longer host; block before allow for one key listed twice). Defined results: a null url or one
without ``://`` has an empty host and path and fits no rule; without a fitting rule the verdict is that of an unlisted url:
allow. Repeated rows and repeated urls each keep their row; an empty rule list allows everything.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # of 32 bits in a block; each key sets one bit in each word of its block
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]  # fixed values of the public split-block filter


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class BlockedBloom:
    """Blocks of 8 x 32 bits. The bits are gathered by a Spark aggregation; its size never exceeds ``max_bytes``: with more
    keys than fit it passes more rows to the exact join, whose result is the same."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @classmethod
    def of(cls, hashes: DataFrame, bits_per_key: int = 16, max_bytes: int = 32 << 20) -> BlockedBloom:
        keys = hashes.select(F.col(hashes.columns[0]).alias("h"))
        n = keys.count()
        size = 1
        while size * WORDS * 32 < n * bits_per_key and size * WORDS * 4 * 2 <= max_bytes:
            size *= 2
        low = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))
        bit = [F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in (x & 0x7FFFFFFF for x in SALTS)]
        block = F.shiftrightunsigned(F.col("h"), 32).bitwiseAND(F.lit(size - 1))
        rows = (
            keys.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bit)])
            .groupBy("block")
            .agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(WORDS)])
            .collect()  # at most max_bytes / 32 rows
        )
        blocks = np.zeros((size, WORDS), dtype=np.uint32)
        for r in rows:
            blocks[r[0]] = [x & 0xFFFFFFFF for x in r[1:]]
        return cls(blocks)

    def has(self, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.int64).view(np.uint64)
        low = h & np.uint64(0xFFFFFFFF)
        block = self.blocks[((h >> np.uint64(32)) & np.uint64(len(self.blocks) - 1)).astype(np.int64)]
        found = np.ones(len(h), dtype=bool)
        for i, s in enumerate(SALTS):
            bit = ((low * np.uint64(s & 0x7FFFFFFF)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            found &= (block[:, i] >> bit.astype(np.uint32)) & np.uint32(1) == 1
        return found


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", bits_per_key: int = 16, max_filter_bytes: int = 32 << 20) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A url is probed only with the shapes that the rules have: (number of host labels, path length). Probes run once per
    distinct (host, path); rules are small or large alike, since Spark broadcasts them only under its size threshold.
    """
    spark = pages.sparkSession
    keys = (
        rules.select(ascii_lower(F.col("host")).alias("rhost"), F.col("path").alias("rpath"), F.col("verdict").alias("rverdict"))
        .where("rhost IS NOT NULL AND rpath IS NOT NULL AND rverdict IS NOT NULL")
        .groupBy("rhost", "rpath")
        .agg(F.max("rverdict").alias("rverdict"))
    )
    shapes = [
        (r[0], r[1])  # bounded: host labels (127 at most in a valid name) times path lengths of the list
        for r in keys.select((F.length("rhost") - F.length(F.replace(F.col("rhost"), F.lit("."), F.lit(""))) + 1).cast("int"), F.length("rpath")).distinct().collect()
    ]
    placed = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shapes:
        return placed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    bits = spark.sparkContext.broadcast(BlockedBloom.of(keys.select(F.xxhash64("rhost", "rpath")), bits_per_key, max_filter_bytes).blocks)

    @F.arrow_udf("boolean")
    def possible(h: pa.Array) -> pa.Array:
        return pa.array(BlockedBloom(bits.value).has(h.to_numpy(zero_copy_only=False)))

    labels = "(length(host) - length(replace(host, '.', '')) + 1)"
    listed = ", ".join(f"struct({k} AS k, {n} AS n)" for k, n in sorted(shapes))
    probes = (
        placed.where("host <> ''")
        .select("host", "path")
        .distinct()
        .withColumn("shape", F.expr(f"explode(filter(array({listed}), s -> s.k <= {labels} AND s.n <= length(path)))"))
        .select("host", "path", F.expr("substring_index(host, '.', -shape.k)").alias("rhost"), F.expr("substring(path, 1, shape.n)").alias("rpath"))
    )
    hits = probes.where(possible(F.xxhash64("rhost", "rpath"))).join(keys, ["rhost", "rpath"])
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct((F.length("rhost") + F.length("rpath")).alias("n"), F.length("rhost").alias("k"), F.concat("rhost", "rpath").alias("rule"), F.col("rverdict").alias("verdict"))).alias("won")
    )
    return placed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit("allow")).alias("verdict"))
