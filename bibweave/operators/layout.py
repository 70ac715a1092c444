"""Segmentation of printed lines into references.

Lines: doc_id, page, line_no, text, x0, y0, x1, y1. line_no counts on over the pages of a document, as ``read_text_blocks`` gives
it; ``number_lines`` makes it so where every page starts anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibweave.session import persisted

#: Numbers that references open with; headers, of which the last two may stand anywhere in a short line (fixed patterns).
NUMBERED = r"^\s*(?=\[\d{1,3}\]\s*\S|\d{1,3}(?:[.)]|-(?!\d))\s*\S)\[?(\d{1,3})"
HEADERS = r"(?iu)^\s*(\d+[.)]?\s*)?(references|sources?|bibliography|works?\s+cited|literature cited|literat[uü]r)\s*[:.]*\s*$|kaynaklar|kaynak[cç]a"
#: Lines of form instructions (fixed patterns).
INSTRUCTIONS = [
    r"^\d{4}BF[-\s]?\d+",
    r"^bu\s+b[oö]l[uü]mde",
    r"^proje\s+[oö]nerisinde",
    r"sayfas[ıi]ndaki\s+a[cç][ıi]klamalara",
    r"verilmeli\s+ve\s+bu\s+kaynaklara",
    r"sonuna\s+DOI\s+numaras[ıi]",
    r"i[cç]erisinde\s+(?:ilgili\s+yerlerde|at[ıi]f)",
    r"^g[uü]ncelleme\s+tarihi",
    r"^zorunludur\s*[.\s]*$",
    r"yap[ıi]lmal[ıi]d[ıi]r",
    r"kaynaklar[ıi]n\s+listesi",
    r"bibliyografik",
    r"verilerin.duzenlenmesi",
    r"eklenmesi\s*$",
    r"Kurum\sİçi\sSınırsız\sKullanım\s/\sKişisel\sVeri\sDeğil",
    r"^\s*\d{4}\s*[-–—]{1,2}\s*BF\s+G[uü]ncelleme\s+Tarihi\s*:\s*\d{2}/\d{2}/\d{4}\s*$",
]
#: What a line of form instructions holds in lower case, one of these at least: letters of the patterns above that are the same in every
#: case form (no i, s or k, which other letters fold to). Lines without any skip the patterns.
INSTRUCTION_PARTS = ["bf", "mde", "proje", "lamalara", "lmel", "onuna", "nde", "ncelleme", "zorunludur", "lmal", "ayna", "yograf", "duzenlenme", "lenme", "urum"]
#: The site whose footer lines are dropped (fixed value).
FOOTER_SITE = "tubitak.gov.tr"
#: How a reference's first line may open (fixed patterns).
AUTHOR_STARTS = [
    r"^[A-ZÀ-ŽÀ-ɏ][A-Za-z0-9_à-žÀ-ɏ'’\-]+,\s+[A-Z]\.",
    r"^[A-ZÀ-ŽÀ-ɏ][A-Za-z0-9_à-žÀ-ɏ'’\-]+,\s+[A-Z][a-zà-žÀ-ɏ]",
    r"^[A-ZÀ-ŽÀ-ɏ][a-zà-žÀ-ɏ]+\s+[A-Z]\.",
    r"^[A-ZÀ-ŽÀ-ɏ][a-zà-žÀ-ɏ]+\s+&",
    r"^[A-Z]{2,},?\s+(?:\d{4}|\(|[A-Z][a-z])",
    r'^"[A-Z]',
    r"^“[A-Z]",
    r"^[A-ZÀ-ŽÀ-ɏ][a-zà-žÀ-ɏ]+\s+\(\d{4}",
    r"^[A-Z][A-Za-z0-9_'’\-]+(?:\s+[A-Z][A-Za-z0-9_'’\-]+){1,5}\.\s+https?://",
]
#: How a line inside a reference may open (fixed patterns).
CONTINUATIONS = [r"^\(\d{4}[a-z]?\)\.?\s", r"^\d+(?:[\-–—]\d+)?\.", r"^[A-Z][\w&'\-\s.]*,\s+\d+(?:\(\d+\))?\s*:\s*\d"]
#: Line ends inside and at the end of a reference (fixed patterns).
UNFINISHED = r"(?i)(?:[,;&:]|\bve|\band|\beds?\.|-|\b[A-Z]\.|\b(?:19|20)\d{2}[a-z]?\.)\s*$"
FINISHED = r"(?i)(?:[.”’\")\]]|https?://\S+|\b10\.\d{4,9}/\S+)\s*$"


def any_of(text: Column, patterns: list[str], flags: str = "") -> Column:
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def starts_with_author(text: Column) -> Column:
    return any_of(text, AUTHOR_STARTS)


def is_instruction(text: Column) -> Column:
    low, may = F.lower(text), F.lit(False)
    for part in INSTRUCTION_PARTS:
        may = may | F.contains(low, F.lit(part))
    return may & any_of(text, INSTRUCTIONS, "(?iu)")


def is_header(text: Column, headers: str = HEADERS) -> Column:
    return (F.length(text) < 50) & text.rlike(headers)


def line_number(text: Column) -> Column:
    """The number that a line opens with, null without one."""
    return F.regexp_extract(text, NUMBERED, 1).try_cast("int")


def number_lines(lines: DataFrame) -> DataFrame:
    """lines with line_no counting on over the pages of each document, from line numbers that start anew on every page."""
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    turned = F.when(F.col("page") != F.lag("page").over(order), F.lag("line_no").over(order) + 1)  # a page's last number, at the next page's first line
    rows = lines.where("doc_id IS NOT NULL AND page IS NOT NULL").withColumn("_turned", turned)
    return rows.withColumn("line_no", (F.col("line_no") + F.coalesce(F.sum("_turned").over(order), F.lit(0))).cast("int")).select(*lines.columns)


def line_filter(lines: DataFrame) -> DataFrame:
    """Without blank lines, bare page numbers, form instructions, repeated headers and the site's footers (unless numbered)."""
    text = F.trim("text")
    footer = F.contains(F.lower(text), F.lit(FOOTER_SITE)) & line_number(text).isNull()
    return lines.where(~F.col("text").rlike(r"^\s*(\d{1,3}\s*)?$") & ~is_instruction(text) & ~is_header(text) & ~footer)


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Pieces of printed lines (doc_id, page, text, box, font_size, is_bold) to whole lines with line_no from 0 on each page.

    In the order of their middles, then from left to right, a piece goes on with the line where its middle is within 0.6 line
    heights of the piece before and the gap is under 3; a blank comes between, but after a hyphen or across less than 0.25.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    order = Window.partitionBy("doc_id", "page").orderBy("middle", "x0", "x1", "text")
    rows = fragments.withColumns({"middle": middle, "tall": F.col("y1") - F.col("y0")})
    last = {c: F.lag(c).over(order) for c in ("middle", "tall", "x1", "text")}
    height = F.greatest(F.col("tall"), last["tall"], F.lit(5.0))
    rows = rows.withColumns({"height": height, "gap": F.col("x0") - last["x1"], "step": F.abs(F.col("middle") - last["middle"]), "hyphen": F.endswith(last["text"], F.lit("-"))})
    joined = (F.col("step") < 0.6 * F.col("height")) & (F.col("gap") < 3 * F.col("height"))
    rows = rows.withColumns({"line_no": (F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(order) - 1).cast("int"), "place": F.row_number().over(order)})
    blank = F.when(F.col("hyphen") | (F.col("gap") < 0.25 * F.col("height")), "").otherwise(" ")
    piece = F.struct("place", F.concat(F.coalesce(blank, F.lit("")), "text").alias("piece"), "text")
    whole = F.array_sort(F.collect_list(piece))
    text = F.concat(F.get(whole, F.lit(0))["text"], F.array_join(F.transform(F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(1))), lambda p: p.piece), ""))
    return rows.groupBy("doc_id", "page", "line_no").agg(
        text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font_size").alias("font_size"), F.bool_or("is_bold").alias("is_bold")
    )


def page_baselines(lines: DataFrame) -> DataFrame:
    """doc_id, page, gap (least non-negative), height (mean), left (least x0)."""
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "line_no")
    gap = F.col("y0") - F.lag("y1").over(order)
    rows = lines.withColumn("gap", gap)
    return rows.groupBy("doc_id", "page").agg(F.min(F.when(F.col("gap") >= 0, F.col("gap"))).alias("gap"), F.avg(F.col("y1") - F.col("y0")).alias("height"), F.min("x0").alias("left"))


def _marked_headers(lines: DataFrame, headers: str) -> DataFrame:
    """lines with header, and following: how many of the next nine have five characters and are no form instructions."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    text = F.trim("text")
    long = F.when((F.length(text) >= 5) & ~is_instruction(text), 1).otherwise(0)
    return lines.withColumns({"header": is_header(text, headers), "following": F.coalesce(F.sum(long).over(order.rowsBetween(1, 9)), F.lit(0))})


def find_header(lines: DataFrame, headers: str = HEADERS) -> DataFrame:
    """doc_id, header_line: the header line, of several the first with three lines of five characters that are no form
    instructions in the next nine, else the first."""
    rows = _marked_headers(lines, headers)
    found = rows.where("header").groupBy("doc_id").agg(F.min(F.when(F.col("following") >= 3, F.col("line_no"))).alias("followed"), F.min("line_no").alias("first"))
    return found.select("doc_id", F.coalesce("followed", "first").alias("header_line"))


def lines_after_header(lines: DataFrame, header: DataFrame) -> DataFrame:
    return lines.join(header, "doc_id").where("line_no > header_line").drop("header_line")


def lines_below_header(lines: DataFrame, headers: str = HEADERS) -> DataFrame:
    """``lines_after_header`` of ``find_header``, in one pass over each document instead of a join of the lines with themselves."""
    whole = Window.partitionBy("doc_id")
    rows = _marked_headers(lines.where("doc_id IS NOT NULL"), headers)
    at = lambda fits: F.min(F.when(fits, F.col("line_no"))).over(whole)
    rows = rows.withColumns({"followed": at(F.col("header") & (F.col("following") >= 3)), "first": at(F.col("header"))})
    return rows.where(F.col("line_no") > F.coalesce("followed", "first")).select(*lines.columns)


def split_numbered(lines: DataFrame) -> DataFrame:
    """lines with ref_no: a line starts reference n only if n follows on (3 at most at first, then up to two ahead); the other
    lines belong to the last one started while they go on with it (``goes_on``). The fold runs over a document's numbered lines
    alone and keeps at most 999 of them, as numbers have three digits and ascend."""
    numbered = lines.select("doc_id", "line_no", line_number(F.col("text")).alias("n")).where("n IS NOT NULL")
    marks = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "n"))).alias("marks"))
    fold = """aggregate(marks, named_struct('at', 0, 'kept', filter(marks, m -> false)), (acc, m) ->
        CASE WHEN (acc.at = 0 AND m.n <= 3) OR (acc.at > 0 AND m.n > acc.at AND m.n <= acc.at + 2)
             THEN named_struct('at', m.n, 'kept', concat(acc.kept, array(m))) ELSE acc END, acc -> acc.kept)"""
    starts = marks.select("doc_id", F.map_from_entries(F.expr(fold)).alias("_starts"))  # joined by document, as the windows below are dealt
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.join(starts, "doc_id", "left").withColumn("n", F.try_element_at("_starts", F.col("line_no"))).drop("_starts").withColumns({"ref_no": F.last("n", ignorenulls=True).over(order).cast("long"), "broken": F.col("n").isNull() & ~goes_on(order)})
    inside = Window.partitionBy("doc_id", "ref_no").orderBy("line_no")
    rows = rows.where("ref_no IS NOT NULL").withColumn("off", F.max("broken").over(inside))
    return rows.where("NOT off").select(*lines.columns, "ref_no")


def goes_on(order) -> Column:
    """Whether a line can belong to the reference of the line before: less than five line heights below, or on the next page."""
    page, y0, y1 = (F.lag(c).over(order) for c in ("page", "y0", "y1"))
    near = (F.col("page") == page) & (F.col("y0") - y1 < 5 * F.greatest(y1 - y0, F.lit(10.0)))
    return F.coalesce(near | (F.col("page") == page + 1), F.lit(False))


def valid_splits(split: DataFrame) -> DataFrame:
    """doc_id of the documents whose numbered split holds: any references, the first number at most 10 and, of more than two, at
    least a third of the steps ascending. All references count."""
    starts = split.groupBy("doc_id", "ref_no").agg(F.min("line_no").alias("line_no"))
    rows = starts.withColumn("step", F.col("ref_no") - F.lag("ref_no").over(Window.partitionBy("doc_id").orderBy("line_no")))
    judged = rows.groupBy("doc_id").agg(F.min_by("ref_no", "line_no").alias("first"), F.count("*").alias("n"), F.count_if(F.col("step") > 0).alias("ascending"))
    return judged.where("first <= 10 AND (n <= 2 OR ascending >= floor(n / 3))").select("doc_id")


def split_by_gaps(lines: DataFrame, least_length: int = 30, least_parts: int = 4) -> DataFrame:
    """lines with ref_no: a reference starts after a blank gap, at a flush line after an indented one, at an author after a
    finished line, and at a flush line or author on a new page. A group shorter than ``least_length`` joins the one before; a
    document with less than ``least_parts`` starts has no such split and gives no rows."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.join(page_baselines(lines).withColumnRenamed("gap", "base"), ["doc_id", "page"])
    last_page, last_y1, last_x, last_text = (F.lag(c).over(order) for c in ("page", "y1", "x0", "text"))
    rows = rows.withColumns({"same_page": F.col("page") == last_page, "before": F.col("y0") - last_y1, "last_x": last_x, "last_text": F.trim(last_text), "t": F.trim("text")})
    base = F.coalesce("base", F.lit(0.0))
    wide = F.col("before") > F.greatest(base + 0.4 * F.col("height"), 3 * base + 1)
    flush, long, author = F.col("x0") <= F.col("left") + 2, F.length("t") >= 15, starts_with_author(F.col("t"))
    indented = flush & (F.col("last_x") > F.col("left") + 3) & long
    named = long & author & ~F.col("last_text").rlike(UNFINISHED) & F.col("last_text").rlike(FINISHED) & ~any_of(F.col("t"), CONTINUATIONS)
    starts = F.col("same_page").isNull() | F.when(F.col("same_page"), wide | indented | named).otherwise((flush | author) & long)
    rows = rows.withColumn("part", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    parts = rows.groupBy("doc_id", "part").agg((F.sum(F.length("t")) + F.count("*") - 1).alias("size"))
    by_part, whole = Window.partitionBy("doc_id").orderBy("part"), Window.partitionBy("doc_id")
    parts = parts.withColumns({"ref_no": F.greatest(F.lit(1), F.sum(F.when((F.col("size") >= least_length) | (F.col("part") == 1), 1).otherwise(0)).over(by_part)).cast("long"), "parts": F.count("*").over(whole)})
    return rows.join(parts.where(F.col("parts") >= least_parts).select("doc_id", "part", "ref_no"), ["doc_id", "part"]).select(*lines.columns, "ref_no")


def split_unnumbered(lines: DataFrame) -> DataFrame:
    """lines with ref_no where neither numbers nor gaps tell: a reference starts at a line that hangs out by more than 3 or opens
    with an author (15 characters at least), and where a line can't go on with the one before (``goes_on``). Lines under 10
    characters and lines that open like the inside of a reference go on."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    t = F.trim("text")
    rows = lines.withColumns({"on": goes_on(order), "hangs": (F.col("page") == F.lag("page").over(order)) & (F.lag("x0").over(order) - F.col("x0") > 3), "t": t})
    inner = (F.length("t") < 10) | any_of(F.col("t"), CONTINUATIONS)
    opens = (F.length("t") >= 15) & (F.coalesce("hangs", F.lit(False)) | (F.col("t").rlike(r'^[\p{Lu}"(“]') & starts_with_author(F.col("t"))))
    starts = ~F.col("on") | (~inner & opens)
    return rows.withColumn("ref_no", F.sum(F.when(starts, 1).otherwise(0)).over(order).cast("long")).select(*lines.columns, "ref_no")


def segment_references(lines: DataFrame) -> DataFrame:
    """doc_id, ref_no, raw, boxes: after the header, by numbers where that split is not empty and valid, else by gaps, else line by
    line. Lines are put together in order; a line that ends in a hyphen joins without a blank."""
    body = persisted(line_filter(lines_below_header(lines)), "lines")
    numbered = persisted(split_numbered(body), "numbered")
    valid = valid_splits(numbered)
    rest = body.join(valid, "doc_id", "left_anti")
    by_gaps = persisted(split_by_gaps(rest), "gaps")
    by_line = split_unnumbered(rest.join(by_gaps.select("doc_id").distinct(), "doc_id", "left_anti"))
    split = persisted(numbered.join(valid, "doc_id", "left_semi").unionByName(by_gaps).unionByName(by_line), "split")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.transform(ordered, lambda s: F.trim(s.text)), "\n"), r"(?<=\p{L})-\n(?=\p{Ll})", ""), r"\s+", " "))
    refs = split.groupBy("doc_id", "ref_no").agg(text.alias("raw"))
    boxes = union_boxes(split).groupBy("doc_id", "ref_no").agg(F.array_sort(F.collect_list(F.struct("page", "x0", "y0", "x1", "y1"))).alias("boxes"))
    return refs.join(boxes, ["doc_id", "ref_no"])


def union_boxes(lines: DataFrame, padding: float = 3.0) -> DataFrame:
    """Per reference and page the box around its lines, padded, not below 0."""
    low = lambda c: F.greatest(F.lit(0.0), F.min(c) - padding)
    return lines.groupBy("doc_id", "ref_no", "page").agg(low("x0").alias("x0"), low("y0").alias("y0"), (F.max("x1") + padding).alias("x1"), (F.max("y1") + padding).alias("y1"))


def group_items_into_lines(items: DataFrame) -> DataFrame:
    """Glyph runs (doc_id, page, item, text, x, y, width, height) to lines: a new line where the baseline moves more than half the
    mean height of neighbours; a blank where the gap is over 0.3 of it."""
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x", "item")
    mean = (F.col("height") + F.lag("height").over(order)) / 2
    rows = items.withColumns({"moved": F.abs(F.col("y") - F.lag("y").over(order)), "mean": mean, "gap": F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)})
    fresh = F.col("moved").isNull() | (F.col("moved") > 0.5 * F.col("mean"))
    rows = rows.withColumn("line", F.sum(F.when(fresh, 1).otherwise(0)).over(order))
    piece = F.concat(F.when(~fresh & (F.col("gap") > 0.3 * F.col("mean")), " ").otherwise(""), "text")
    place = F.row_number().over(order)
    rows = rows.withColumns({"piece": piece, "place": place})
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda s: s.piece), "")
    return rows.groupBy("doc_id", "page", "line").agg(lines.alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"))


def text_in_box(items: DataFrame, boxes: DataFrame, tolerance: float = 2.0, row: float = 3.0) -> DataFrame:
    """box_id, text of the items (x0, y0, x1, y1) that meet each box of their page, in reading order: by rows, then from the left. A
    row goes on while baselines (y1) follow one another by ``row`` at most."""
    b = boxes.select("box_id", "doc_id", "page", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = items.join(b, ["doc_id", "page"]).where(
        (F.col("x0") < F.col("bx1") + tolerance) & (F.col("x1") > F.col("bx0") - tolerance) & (F.col("y0") < F.col("by1") + tolerance) & (F.col("y1") > F.col("by0") - tolerance)
    )
    down = Window.partitionBy("box_id").orderBy("y1", "x0", "text")
    hit = hit.withColumn("fresh", F.when(F.col("y1") - F.lag("y1").over(down) > row, 1).otherwise(0))
    hit = hit.withColumn("row", F.sum("fresh").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "x0", "y1", "text"))), lambda s: s.text), " ")
    return hit.groupBy("box_id").agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))


def nearest_reference(refs: DataFrame, far: float = 100_000.0) -> DataFrame:
    """ref_id, nearest: the reference of the same document with the closest box centre (of equally close ones the first id); other
    pages count ``far`` more. Each reference meets those of its document: a bibliography, hundreds of rows."""
    centre = refs.select("doc_id", "ref_id", "page", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    other = centre.select("doc_id", *[F.col(c).alias(f"o_{c}") for c in ("ref_id", "page", "cx", "cy")])
    distance = F.hypot(F.col("cx") - F.col("o_cx"), F.col("cy") - F.col("o_cy")) + F.when(F.col("page") != F.col("o_page"), far).otherwise(0.0)
    met = centre.join(other, "doc_id").where("ref_id <> o_ref_id").withColumn("distance", distance)
    return met.groupBy("ref_id").agg(F.min_by("o_ref_id", F.struct("distance", "o_ref_id")).alias("nearest"))


def previous_reference(refs: DataFrame) -> DataFrame:
    """ref_id, previous: the reference of the same document with the number before (of several the first id)."""
    before = refs.select("doc_id", (F.col("ref_number") + 1).alias("ref_number"), F.col("ref_id").alias("previous"))
    return refs.select("doc_id", "ref_number", "ref_id").join(before.groupBy("doc_id", "ref_number").agg(F.min("previous").alias("previous")), ["doc_id", "ref_number"]).select("ref_id", "previous")


def merge_references(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """ref_id, raw, boxes, status of references put together (groups: ref_id, into): texts in reading order (page, then y0), boxes
    joined per page, status ``edited``. refs: ref_id, raw, page, y0 of the first box, boxes (page, x0, y0, x1, y1)."""
    rows = refs.join(groups, "ref_id")
    texts = F.array_sort(F.collect_list(F.struct("page", "y0", "ref_id", F.trim("raw").alias("raw"))))
    merged = rows.groupBy("into").agg(F.trim(F.array_join(F.transform(texts, lambda t: t.raw), " ")).alias("raw"))
    pages = rows.select("into", F.explode("boxes").alias("b")).groupBy("into", "b.page").agg(*[f(f"b.{c}").alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    boxes = pages.groupBy("into").agg(F.array_sort(F.collect_list(F.struct("page", "x0", "y0", "x1", "y1"))).alias("boxes"))
    return merged.join(boxes, "into").select(F.col("into").alias("ref_id"), "raw", "boxes", F.lit("edited").alias("status"))


#: Measures of a note below a reference (fixed values): the gap to the box, the inner padding, the share of the font size that a
#: character takes.
NOTE_GAP, NOTE_PADDING, CHARACTER_WIDTH = 4.0, 4.0, 0.55


def decision_notes(refs: DataFrame, pages: DataFrame, decision: str, text: str, font_size: float = 10.0, height: float = 18.0) -> DataFrame:
    """ref_id, kind, page, x0, y0, x1, y1, text, decision: for each reference with the decision (refs: doc_id, ref_number, ref_id,
    raw, decision, boxes) a highlight per box, and below the first box a callout, left and right in turn; none where it would
    lie below the page (pages: doc_id, page, page_height)."""
    chosen = refs.where(F.col("decision") == decision)
    marks = chosen.select("doc_id", "ref_id", F.lit("highlight").alias("kind"), F.explode("boxes").alias("b"), F.col("raw").alias("text")).select("doc_id", "ref_id", "kind", "b.page", "b.x0", "b.y0", "b.x1", "b.y1", "text")
    anchor = chosen.select("doc_id", "ref_number", "ref_id", F.get("boxes", F.lit(0)).alias("a")).select("doc_id", "ref_number", "ref_id", "a.page", "a.x0", "a.x1", (F.col("a.y1") + NOTE_GAP).alias("y0"))
    fits = anchor.join(pages, ["doc_id", "page"]).where("y0 < page_height")
    left = F.row_number().over(Window.partitionBy("doc_id").orderBy("ref_number", "ref_id")) % 2 == 1
    width = len(text) * CHARACTER_WIDTH * font_size + 2 * NOTE_PADDING + 1
    placed = fits.withColumn("left", left).select(
        "doc_id", "ref_id", F.lit("callout").alias("kind"), "page", F.when(F.col("left"), F.col("x0")).otherwise(F.col("x1") - width).alias("x0"), "y0",
        F.when(F.col("left"), F.col("x0") + width).otherwise(F.col("x1")).alias("x1"), F.least(F.col("y0") + height, F.col("page_height")).alias("y1"), F.lit(text).alias("text"),
    )
    return marks.unionByName(placed).withColumn("decision", F.lit(decision))


def replace_notes(notes: DataFrame, fresh: DataFrame, decision: str) -> DataFrame:
    """Notes after a run for one decision: its earlier automatic notes go, all others stay."""
    return notes.where(~F.col("decision").eqNullSafe(F.lit(decision))).unionByName(fresh)
