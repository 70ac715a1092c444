"""Exact deduplication: group by a 128-bit content hash and by the bytes themselves, keep the smallest id.

Defined results: null text counts as empty; texts are equal when identical after each run of ASCII white space became one
space (ends are not trimmed). A null id is larger than any other and stays only in a group without ids. Rows that repeat id
and text are one document: one of them stays. Other input columns, whatever their names, don't matter to
``duplicate_groups`` and are carried by ``keep_first``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The grouping key is (128-bit hash, normalised bytes): Spark compares the bytes of rows whose hashes agree, so a collision
    makes two groups. Copies collapse before the shuffle (partial aggregation), so a hot group costs one row per map task.
    Rows find their group again by both digests; a hot group there is an ordinary skewed equi-join, which AQE splits.
    """
    base = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    groups = (
        base.groupBy(F.unhex(F.md5("_norm")).alias("_h"), "_norm")
        .agg(F.count("*").alias("group_size"), F.min("_id").alias("keep_id"))
        .select("_h", F.unhex(F.sha2("_norm", 256)).alias("_sha"), "group_size", "keep_id")
    )
    rows = base.select("_id", F.unhex(F.md5("_norm")).alias("_h"), F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    joined = rows.join(groups, ["_h", "_sha"])
    # rows that repeat an id are few: they meet by (id, hash), never by the hash alone
    first = F.row_number().over(Window.partitionBy("_id", "_h").orderBy("_sha"))
    return joined.repartition("_id", "_h").select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (first == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay."""
    names = docs.columns
    fresh = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    keyed = fresh.withColumns({"_norm_h": F.unhex(F.md5(normalised(F.col(text)))), "_norm_sha": F.unhex(F.sha2(normalised(F.col(text)), 256))})
    groups = (
        docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
        .groupBy(F.unhex(F.md5("_norm")).alias("_norm_h"), "_norm")
        .agg(F.min("_id").alias("_keep"))
        .select("_norm_h", F.unhex(F.sha2("_norm", 256)).alias("_norm_sha"), "_keep")
    )
    kept = keyed.join(groups, ["_norm_h", "_norm_sha"]).where(F.col(ident).eqNullSafe(F.col("_keep")))
    rank = F.row_number().over(Window.partitionBy("_norm_h", "_norm_sha").orderBy(F.xxhash64(*fresh.columns)))
    return kept.withColumn("_rank", rank).where("_rank = 1").select(*fresh.columns).toDF(*names)
