"""Readers and writers of the JSON, JSONL, text and CSV forms that the checking jobs exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibweave.sources.snapshots import aligned, open_snapshot, replace_keys, write_snapshot

BOX = "struct<x0: double, y0: double, x1: double, y1: double, page: int>"
DOCUMENT = "id string, name string, path string, pages array<struct<page_num: int, width: double, height: double, text_blocks: array<struct<text: string, bbox: array<double>, page: int, font_size: double, font_name: string, is_bold: boolean>>>>"
REFERENCES = f"pdf_id string, numbered boolean, approved boolean, page_count string, sources array<struct<id: string, bbox: {BOX}, bboxes: array<{BOX}>, text: string, ref_number: int, status: string>>"
STORED_REFERENCES = REFERENCES.replace("page_count string", "page_count int")
SPAN_LABELS = "id string, source_pdf string, text string, entities array<struct<start: int, `end`: int, label: string>>"
#: Rules that apply where a user has set none (fixed values).
DEFAULT_RULES = "@non-doi-url | DOI olmayan bağlantı\narXiv | arXiv ön baskı, hakemli değil\nProceedings | Konferans bildirisi\nOECD | Ekonomik İşbirliği ve Kalkınma Örgütü raporu"


def read_text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents to one row per printed line; line_no counts on over the pages of a document."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    blocks = F.flatten(F.transform("pages", lambda p: F.transform(p.text_blocks, lambda b: F.struct(p.page_num.alias("page"), b.alias("b")))))
    lines = docs.select(F.col("id").alias("doc_id"), F.posexplode(blocks).alias("line_no", "x")).select("doc_id", "x.page", "line_no", "x.b")
    box = [F.get("b.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return lines.select("doc_id", "page", "line_no", "b.text", *box, "b.font_size", "b.font_name", "b.is_bold")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """One row per reference, of a folder of JSON files or of what ``write_references`` stored; a row without a status takes the
    file's; files that aren't JSON give no rows."""
    snapshot = open_snapshot(spark, path)
    files = snapshot.rows(STORED_REFERENCES, "json") if snapshot else spark.read.schema(REFERENCES).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = files.where("pdf_id IS NOT NULL").select("pdf_id", "numbered", "approved", F.col("page_count").try_cast("int").alias("page_count"), F.inline("sources"))
    status = F.coalesce("status", F.when(F.coalesce("approved", F.lit(False)), "approved").otherwise("detected"))
    return rows.select(F.col("pdf_id").alias("doc_id"), F.col("id").alias("ref_id"), F.col("text").alias("raw"), "ref_number", status.alias("status"), "bbox", "bboxes", "numbered", "page_count")


def write_references(refs: DataFrame, path: str, buckets: int = 64) -> int:
    """One JSON row per document in a snapshot store: approved where it has references and all are; boxes rounded to hundredths;
    nulls left out. Only the documents at hand are replaced, in one step; numbered and page_count that refs doesn't know keep
    their stored value. Returns the version."""
    for c in ("numbered", "page_count"):
        if c not in refs.columns:
            refs = refs.withColumn(c, F.lit(None).cast("boolean" if c == "numbered" else "int"))
    rounded = lambda b: F.struct(*[F.bround(b[c], 2).alias(c) for c in ("x0", "y0", "x1", "y1")], b["page"].alias("page"))
    source = F.struct(F.col("ref_number"), F.col("ref_id").alias("id"), F.col("raw").alias("text"), "status", F.transform("bboxes", rounded).alias("bboxes"))
    known = [F.first(c, ignorenulls=True).alias(c) for c in ("numbered", "page_count")]
    rows = refs.groupBy(F.col("doc_id").alias("pdf_id")).agg(F.bool_and(F.col("status") == "approved").alias("approved"), *known, F.array_sort(F.collect_list(source)).alias("sources"))
    return write_snapshot(aligned(rows, STORED_REFERENCES), path, "pdf_id", "json", buckets, _keep_known, ignoreNullFields=True)


def _keep_known(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored documents replaced by those at hand, which take over what they don't know themselves."""
    stored = old.select(F.col("pdf_id").alias("_id"), F.col("numbered").alias("_numbered"), F.col("page_count").alias("_page_count"))
    filled = new.join(stored, F.col("pdf_id").eqNullSafe(F.col("_id")), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("numbered", "page_count")})
    return replace_keys("pdf_id")(old, filled.select(new.columns))


def all_approved(refs: DataFrame) -> DataFrame:
    """doc_id, approved: whether a document has references and all are approved."""
    return refs.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("status") == "approved", F.lit(False))).alias("approved"))


def numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of text files of any size: the lines of a file's splits are counted, then numbered within each split."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("_at"))
    return rows.withColumn("inside", inside).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).cast("int").alias("line_no"), "line")


def read_span_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, id, source_pdf, text, entities, malformed; blank lines skipped."""
    lines = numbered_text(spark, path).where(F.trim("line") != "")
    parsed = F.from_json("line", SPAN_LABELS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("file", "line_no", parsed.alias("r")).select("file", "line_no", "r.*")
    return rows.withColumn("malformed", F.col("_bad").isNotNull()).drop("_bad")


def read_exclusion_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """ord, word, reason, kind of ``word | reason`` lines; # comments and blank lines skipped."""
    whole = spark.read.text(path, wholetext=True) if path else spark.createDataFrame([(DEFAULT_RULES,)], "value string")
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim("line")).where("line <> '' AND line NOT LIKE '#%'")
    word, reason = (F.trim(F.split_part("line", F.lit("|"), F.lit(i))) for i in (1, 2))
    link = F.lower(word) == "@non-doi-url"
    return lines.select("ord", F.when(~link, F.lower(word)).alias("word"), reason.alias("reason"), F.when(link, "non-doi-url").alias("kind"))


def write_label_buckets(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").partitionBy("bucket").json(path)


def write_comparison_csv(rows: DataFrame, path: str) -> None:
    flat = rows.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)


def is_apa_like(text: Column) -> Column:
    return F.substring(text, 1, 200).rlike(r"\([12]\d{3}[a-z]?\)")
