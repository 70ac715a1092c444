"""Roll-ups and audits over verification results, extractions, spans and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ["high", "medium", "low", "in_progress"]
DECISIONS = ["valid", "citation", "fabricated"]


def status_rollup(results: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per document the number of each band, the total, and whether it is completed: nothing in progress, and any result or the
    whole job done. ``documents`` (doc_id, job_done) adds documents without results."""
    counts = [F.count_if(F.col("status") == b).alias(b) for b in BANDS]
    per = results.groupBy("doc_id").agg(*counts, F.count("*").alias("total"))
    if documents is None:
        return per.withColumn("completed", F.col("in_progress") == 0)
    every = documents.join(per, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in [*BANDS, "total"]})
    return every.select("doc_id", *BANDS, "total", ((F.col("in_progress") == 0) & ((F.col("total") > 0) | F.coalesce("job_done", F.lit(False)))).alias("completed"))


def decision_rollup(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Bands and decisions per document and for the corpus (doc_id null). A row counts by its settled state, one in progress by the
    prior snapshot, one without either not at all; a low row with neither a match nor a searched database has no decision."""
    state = ["status", "decision", "has_match", "n_searched"]
    before = prior.select("ref_id", *[F.col(c).alias(f"_{c}") for c in state])
    rows = current.join(before, "ref_id", "left")
    settled = F.col("status").isin(*BANDS[:3])
    fall = (F.col("status") == "in_progress") & F.col("_status").isNotNull()
    rows = rows.withColumns({c: F.when(settled, F.col(c)).when(fall, F.col(f"_{c}")) for c in state})
    idle = (F.col("status") == "low") & ~F.coalesce("has_match", F.lit(False)) & (F.coalesce("n_searched", F.lit(0)) == 0)
    counted = [F.count_if(F.col("status") == b).alias(b) for b in BANDS[:3]] + [F.count_if((F.col("decision") == d) & ~idle).alias(d) for d in DECISIONS]
    return rows.rollup("doc_id").agg(*counted, F.count("*").alias("total"))


def retrieval_outcomes(events: DataFrame, outcomes: list[str]) -> DataFrame:
    return events.groupBy("source_db").pivot("outcome", outcomes).count().fillna(0)


def databases_searched(events: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Per reference the different databases asked, failures included; in the registry's order (order: source_db, ord) where given,
    databases that it doesn't list last."""
    if order is None:
        return events.groupBy("ref_no").agg(F.array_sort(F.collect_set("source_db")).alias("databases"))
    rows = events.select("ref_no", "source_db").distinct().join(order, "source_db", "left")
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(1 << 30)).alias("ord"), "source_db")))
    return rows.groupBy("ref_no").agg(F.transform(listed, lambda s: s.source_db).alias("databases"))


def latency_summary(log: DataFrame, value: str, by: str, cells: int = 4096) -> DataFrame:
    """p50, p95, p99 as the element at floor(n p) of the sorted values, and the mean, of each key.

    A key's range is cut into equal cells whose counts find the cell of each percentile; only the different values of these cells
    are ranked. So a key of any size costs ``cells`` rows and a share of its values, not all of them, in one task.
    """
    n = log.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    wanted = [F.struct(F.lit(f"p{round(p * 100)}").alias("p"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("at")) for p in (0.5, 0.95, 0.99)]
    n = n.withColumn("wanted", F.array(*wanted))
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1))).otherwise(0)
    rows = log.where(F.col(value).isNotNull()).join(n.select(by, "low", "high"), by).groupBy(by, cell.alias("cell"), value).agg(F.count("*").alias("c"))
    along = Window.partitionBy(by).orderBy("cell")
    upto = rows.groupBy(by, "cell").agg(F.sum("c").alias("c")).withColumn("before", F.sum("c").over(along) - F.col("c"))
    asked = n.select(by, F.explode("wanted").alias("w")).select(by, "w.p", "w.at")
    ends = upto.join(asked, by).where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("c"))).select(by, "cell", "before", "p", "at")
    inside = Window.partitionBy(by, "cell", "p").orderBy(value)
    picked = rows.join(ends, [by, "cell"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    out = picked.where(F.col("upto") > F.col("at")).groupBy(by).agg(*[F.min(F.when(F.col("p") == p, F.col(value))).alias(p) for p in ("p50", "p95", "p99")])
    return out.join(n.select(by, "n", "mean"), by).select(by, "n", "p50", "p95", "p99", "mean")


def request_budget(log: DataFrame, key: str, cap: int) -> DataFrame:
    """Per key and UTC day: used, remaining."""
    used = log.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(0), F.lit(cap) - F.col("used")))


def trailing_requests(log: DataFrame, key: str, ident: str, seconds: int, cap: int) -> DataFrame:
    """Per request the number of requests of its key in the trailing window, and whether it is over the cap. The window is cut
    into whole buckets by time, and a row meets the rows of its own and the last bucket, so a busy key spreads over tasks."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.select(key, ident, at.alias("us")).withColumn("bucket", F.floor(F.col("us") / (seconds * 1_000_000)))
    # a row is shown to its own bucket and the next; the window inside a bucket then covers both
    shown = rows.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("bucket", F.when(F.col("own"), F.col("bucket")).otherwise(F.col("bucket") + 1))
    frame = Window.partitionBy(key, "bucket").orderBy("us").rangeBetween(-(seconds * 1_000_000), 0)
    return shown.withColumn("n", F.count("*").over(frame)).where("own").select(key, ident, "n", (F.col("n") > cap).alias("over"))


def bucket_summary(rows: DataFrame, by: str) -> DataFrame:
    """Count and percentage of each bucket."""
    total = rows.agg(F.count("*").alias("all"))
    return rows.groupBy(by).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(by, "n", F.round(F.col("n") * 100.0 / F.col("all"), 2).alias("percent"))


def dedup_first(rows: DataFrame, text: Column, order: list[str]) -> DataFrame:
    """Of equal stripped texts the first row by order, with the number of copies; aggregated before the shuffle."""
    packed = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(F.trim(text).alias("_text")).agg(F.min(packed).alias("row"), F.count("*").alias("copies")).select("row.*", "copies")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def diff_references(approved: DataFrame, detected: DataFrame) -> DataFrame:
    """Per document: matched, missing, extra reference numbers, and equal texts."""
    a = approved.select("doc_id", "ref_number", F.col("raw").alias("want"), F.lit(True).alias("in_a"))
    b = detected.select("doc_id", "ref_number", F.col("raw").alias("got"), F.lit(True).alias("in_b"))
    both = a.join(b, ["doc_id", "ref_number"], "full")
    return both.groupBy("doc_id").agg(
        F.count_if(F.col("in_a") & F.col("in_b") & (F.col("want") == F.col("got"))).alias("equal"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("matched"),
        F.count_if(F.col("in_b").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("extra"),
    )


def first_divergence(want: Column, got: Column) -> Column:
    """1-based place of the first differing character, null for equal texts."""
    same = F.zip_with(F.split(want, ""), F.split(got, ""), lambda a, b: a.eqNullSafe(b))
    return F.nullif(F.array_position(same, False), F.lit(0).cast("long"))


def missing_references(approved: DataFrame, detected: DataFrame) -> DataFrame:
    """doc_id, ref_number, kind, want: references that were approved but not detected. Sides turned around, those detected in excess."""
    lost = approved.join(detected.select("doc_id", "ref_number"), ["doc_id", "ref_number"], "left_anti")
    return lost.select("doc_id", "ref_number", F.lit("missing").alias("kind"), F.col("raw").alias("want"))


def reference_differences(approved: DataFrame, detected: DataFrame) -> DataFrame:
    """doc_id, ref_number, kind (missing, extra, shorter, longer, changed) and diverges_at of every reference that isn't equal."""
    a = approved.select("doc_id", "ref_number", F.col("raw").alias("want"))
    b = detected.select("doc_id", "ref_number", F.col("raw").alias("got"))
    both = a.join(b, ["doc_id", "ref_number"], "full").where(~F.col("want").eqNullSafe(F.col("got")))
    longer = F.length("got") - F.length("want")
    kind = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(longer < 0, "shorter").when(longer > 0, "longer").otherwise("changed")
    return both.select("doc_id", "ref_number", kind.alias("kind"), first_divergence(F.col("want"), F.col("got")).alias("diverges_at"))


def ner_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of exact spans (ref_id, label, start, end) per label and overall (label null)."""
    key = ["ref_id", "label", "start", "end"]
    both = gold.select(*key, F.lit(1).alias("g")).distinct().join(pred.select(*key, F.lit(1).alias("p")).distinct(), key, "full")
    counts = both.rollup("label").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("p").alias("predicted"), F.count("g").alias("support"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = safe(F.col("tp"), F.col("predicted")), safe(F.col("tp"), F.col("support"))
    return counts.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"), "support")


def attach_liveness(urls: DataFrame, probes: DataFrame) -> DataFrame:
    """Per url whether it lives: HEAD below 400, or HEAD refused (403, 404, 405) and GET below 400; unknown is false."""
    alive = (F.col("head") < 400) | (F.col("head").isin(403, 404, 405) & (F.coalesce("get", F.lit(999)) < 400))
    known = probes.groupBy("url").agg(F.bool_or(F.coalesce(alive, F.lit(False))).alias("alive"))
    return urls.join(known, "url", "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
