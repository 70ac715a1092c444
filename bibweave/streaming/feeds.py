"""Structured Streaming over the verification's event feed. The feed's rules (active run wins, polling) have no event time;
watermarks and windows are what a Spark user adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bibweave.operators.catalog_index import CatalogIndex, build_catalog_index, open_catalog_index
from bibweave.operators.linkage import verify
from bibweave.sources.snapshots import open_snapshot, write_snapshot


def read_feed(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def dedup_events(events: DataFrame, ident: str, late: str = "1 hour") -> DataFrame:
    """Each event once; state is dropped when the watermark passes."""
    if not events.isStreaming:
        return events.dropDuplicates([ident])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([ident])


def outcome_rates(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, source_db, outcome, n by event-time window; later events are dropped from a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "source_db", "outcome").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source_db", "outcome", "n")


def request_rates(log: DataFrame, cap: int, width: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """start, host, n, over by sliding window."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "host").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "host", "n", (F.col("n") > cap).alias("over"))


def latest_progress(events: DataFrame) -> DataFrame:
    """Per reference the last event of its newest run; events of older runs are stale. Aggregates only, so a busy reference
    collapses before the shuffle."""
    last = events.groupBy("ref_no").agg(F.max(F.struct("job_no", "ts", "event_id", "source_db", "outcome")).alias("e"))
    return last.select("ref_no", "e.job_no", "e.ts", "e.event_id", "e.source_db", "e.outcome")


PROGRESS = ["ref_no", "job_no", "ts", "event_id", "source_db", "outcome"]


def progress_stream(events: DataFrame, store: str, checkpoint: str, parts: int = 64) -> object:
    """Keeps latest_progress as a snapshot store of ``parts`` buckets by reference. A micro-batch reads and rewrites only the buckets
    that its references are in and then publishes them in one step, so a run that is killed leaves the last whole batch; as the
    newest event is a maximum, replaying one changes nothing."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return latest_progress(old.unionByName(new))

    def run(batch: DataFrame, epoch: int) -> None:
        write_snapshot(latest_progress(batch.select(PROGRESS)), store, "ref_no", buckets=parts, merge=merge)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_progress(spark: SparkSession, store: str) -> DataFrame:
    """The newest snapshot of what ``progress_stream`` keeps."""
    snapshot = open_snapshot(spark, store)
    if snapshot is None:
        raise ValueError(f"no progress stored in {store}")
    return snapshot.rows(snapshot.schema("parquet"), "parquet")


def verify_stream(refs: DataFrame, catalog: DataFrame | CatalogIndex, sink: Callable[[DataFrame, int], None], checkpoint: str) -> object:
    """Verifies each micro-batch of references and hands the results to ``sink``. The catalog is indexed once, before the stream
    starts, unless it is a stored index; every micro-batch opens the index's newest version, so appended works are found from
    the next one on."""
    index = catalog if isinstance(catalog, CatalogIndex) else build_catalog_index(catalog)

    def run(batch: DataFrame, epoch: int) -> None:
        sink(verify(batch, open_catalog_index(batch.sparkSession, index.folder)), epoch)

    return refs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_events(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each source (a report)."""
    order = Window.partitionBy("source_db").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
