"""The corpus pipeline: quality filter, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, whatever their
names (extra columns are carried and clash with nothing), and give an empty table for an empty one. Null texts count as empty,
rows without an id are rows like others, and documents without words leave with the mixing stage, which samples words. Rows are
dropped one by one: an id that repeats on another text is another document. A document that the mix takes k times is k equal
rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibweave.llm import exact_dedup, jaccard, mixing, packing, quality
from bibweave.llm.queries import table, tokenizer_path
from bibweave.session import persisted


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.5 go."""
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(spark, model, F.col("text")) >= 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; of rows equal in id and text, one."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, with the smallest id (nulls last; ties by row hash)."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sampled by quality score. The classifier is the filter's: fitted on the whole
    table, as the bad examples it needs are gone from what the filter kept."""
    return mixing.mixed_rows(docs, weigh=quality.weight_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = persisted(docs, name.replace(" ", "-"))
    return docs
