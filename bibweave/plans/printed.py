"""Queries over printed lines and references on pages: every page numbers its lines anew, as parsed documents do."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibweave.operators import layout
from bibweave.plans.derived import LINES, LINES_AT_ONCE, REFS, derived, duck, refs
from bibweave.plans.queries import query

#: The printed lines with numbers that start at 0 on every page, and with what the filter must drop: an instruction in place of
#: each seventh reference's second line, the site's footer in place of page numbers.
PAGED_LINES = """SELECT doc_id, page, CAST(line_no - (page - 1) * 12 AS INT) AS line_no, CASE WHEN line_no % 21 = 11 THEN 'Zorunludur.' WHEN text = ' 17 ' AND line_no % 2 = 0 THEN 'see tubitak.gov.tr page 3' ELSE text END AS text, x0, y0, x1, y1 FROM ({lines}) AS l"""
PAGED = PAGED_LINES.format(lines=LINES)


def paged(spark, sf_dir):
    return derived(spark, sf_dir, PAGED_LINES.format(lines=LINES_AT_ONCE))


def numbered(spark, sf_dir):
    return layout.number_lines(paged(spark, sf_dir))


@query(f"SELECT doc_id, page, line_no, length(text) AS size FROM {duck(LINES)}")
def number_lines(spark, sf_dir):
    return layout.number_lines(derived(spark, sf_dir, f"SELECT doc_id, page, CAST(line_no - (page - 1) * 12 AS INT) AS line_no, text FROM ({LINES_AT_ONCE}) AS l")).select("doc_id", "page", "line_no", F.length("text").alias("size"))


KEPT = f"""(SELECT * FROM (SELECT p.* REPLACE (line_no + (page - 1) * 12 AS line_no) FROM {duck(PAGED)} p) WHERE trim(text) <> '' AND NOT regexp_matches(text, '^\\s*\\d{{1,3}}\\s*$') AND text <> 'Zorunludur.' AND NOT contains(text, 'tubitak')
    AND NOT regexp_matches(lower(text), '^(references|kaynaklar)$'))"""


@query(f"SELECT doc_id, line_no FROM {KEPT}")
def paged_line_filter(spark, sf_dir):
    return layout.line_filter(numbered(spark, sf_dir)).select("doc_id", "line_no")


@query(f"SELECT DISTINCT doc_id, 0 AS header_line FROM {duck(LINES)}")
def paged_header(spark, sf_dir):
    """The header's line; every document also repeats the header as its last line, which must not win."""
    rows = numbered(spark, sf_dir)
    last = rows.groupBy("doc_id").agg(F.max("page").alias("page"), (F.max("line_no") + 1).alias("line_no"))
    again = last.select("doc_id", "page", "line_no", F.lit("References").alias("text"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return layout.find_header(rows.unionByName(again)).select("doc_id", F.col("header_line").cast("int").alias("header_line"))


@query(f"SELECT doc_id, line_no, CAST((line_no + 2) // 3 AS BIGINT) AS ref_no FROM {KEPT} WHERE doc_id % 3 > 0")
def split_numbered(spark, sf_dir):
    """Numbered documents of several pages: every line after the header in its reference."""
    body = layout.line_filter(layout.lines_below_header(numbered(spark, sf_dir)))
    return layout.split_numbered(body.where("doc_id % 3 > 0")).select("doc_id", "line_no", "ref_no")


@query(f"""WITH l AS (SELECT *, (line_no + 2) // 3 AS n FROM {KEPT} WHERE doc_id % 3 > 0), t AS (SELECT doc_id, n, string_agg(trim(text), chr(10) ORDER BY line_no) AS joined, count(DISTINCT page) AS pages FROM l GROUP BY ALL)
    SELECT doc_id, CAST(n AS BIGINT) AS ref_no, trim(regexp_replace(regexp_replace(joined, '([a-zA-Z])-\\n([a-z])', '\\1\\2', 'g'), '\\s+', ' ', 'g')) AS raw, CAST(pages AS INT) AS pages FROM t""")
def segment_numbered(spark, sf_dir):
    """segment_references on the documents with numbers, texts and all."""
    out = layout.segment_references(numbered(spark, sf_dir).where("doc_id % 3 > 0"))
    return out.select("doc_id", "ref_no", "raw", F.size("boxes").alias("pages"))


#: Unnumbered documents: hanging first lines, 8 points apart, an indented second line, a wide gap before every fourth reference.
HANGING = f"""SELECT doc_id, 1 AS page, CAST(n * 2 + half AS INT) AS line_no, CASE WHEN half = 0 THEN concat('Keller, A. (2001). Title number ', n, ' of a longer kind') ELSE 'and the rest of the line, in a journal.' END AS text,
    CAST(CASE WHEN half = 0 THEN 50 ELSE 62 END AS DOUBLE) AS x0, CAST(n * 24 + half * 12 AS DOUBLE) AS y0, CAST(300 AS DOUBLE) AS x1, CAST(n * 24 + half * 12 + 10 AS DOUBLE) AS y1
    FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ref_id) AS n FROM ({REFS}) AS f) AS r CROSS JOIN (SELECT 0 AS half UNION ALL SELECT 1) AS h"""


@query(f"SELECT doc_id, line_no, CAST(line_no // 2 AS BIGINT) AS ref_no FROM {duck(HANGING)} WHERE doc_id IN (SELECT doc_id FROM {duck(HANGING)} GROUP BY doc_id HAVING count(*) >= 8)")
def split_by_gaps(spark, sf_dir):
    """Documents of four references or more; fewer have no such split."""
    return layout.split_by_gaps(derived(spark, sf_dir, HANGING)).select("doc_id", "line_no", "ref_no")


@query(f"SELECT doc_id, line_no, CAST(line_no // 2 AS BIGINT) AS ref_no FROM {duck(HANGING)}")
def split_unnumbered(spark, sf_dir):
    return layout.split_unnumbered(derived(spark, sf_dir, HANGING)).select("doc_id", "line_no", "ref_no")


#: Pieces of lines: words of a title side by side, touching, apart by a blank, or after a hyphen; one piece far to the right.
PIECES = f"""SELECT ref_id AS doc_id, 1 AS page, CASE part WHEN 0 THEN concat('Deep', CASE WHEN kind % 3 = 2 THEN '-' ELSE '' END) WHEN 1 THEN 'learning' WHEN 2 THEN 'far' ELSE 'below' END AS text,
    CAST(CASE part WHEN 0 THEN 0 WHEN 1 THEN 20 + (kind % 3) * 4 WHEN 2 THEN 400 ELSE 0 END AS DOUBLE) AS x0, CAST(CASE part WHEN 3 THEN 30 ELSE kind % 2 END AS DOUBLE) AS y0,
    CAST(CASE part WHEN 0 THEN 20 WHEN 1 THEN 60 + (kind % 3) * 4 WHEN 2 THEN 420 ELSE 30 END AS DOUBLE) AS x1, CAST(CASE part WHEN 3 THEN 40 ELSE kind % 2 + 10 END AS DOUBLE) AS y1, CAST(9 + part AS DOUBLE) AS font_size, part = 1 AS is_bold
    FROM ({REFS}) AS r CROSS JOIN (SELECT 0 AS part UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS p"""


@query(f"""SELECT ref_id AS doc_id, n AS line_no, CASE n WHEN 0 THEN CASE kind % 3 WHEN 0 THEN 'Deeplearning' WHEN 1 THEN 'Deep learning' ELSE 'Deep-learning' END WHEN 1 THEN 'far' ELSE 'below' END AS text,
    CAST(CASE n WHEN 0 THEN 60 + (kind % 3) * 4 WHEN 1 THEN 420 ELSE 30 END AS DOUBLE) AS x1, CAST(10 + n + CASE WHEN n = 0 THEN 0 ELSE 0 END AS DOUBLE) AS font_size, n = 0 AS is_bold FROM {duck(REFS)} CROSS JOIN (SELECT unnest([0, 1, 2]) AS n)""")
def merge_fragments(spark, sf_dir):
    out = layout.merge_fragments(derived(spark, sf_dir, PIECES))
    return out.select("doc_id", "line_no", "text", "x1", "font_size", "is_bold")


PLACED = f"""SELECT ref_id, doc_id, ref_number, title AS raw, kind, CAST(1 + ref_number % 2 AS INT) AS page, CAST(50 + kind AS DOUBLE) AS x0, CAST(ref_number * 40 AS DOUBLE) AS y0, CAST(300 + kind AS DOUBLE) AS x1, CAST(ref_number * 40 + 20 AS DOUBLE) AS y1,
    CASE WHEN kind % 3 = 0 THEN 'valid' WHEN kind % 3 = 1 THEN 'citation' ELSE 'fabricated' END AS decision FROM ({REFS}) AS r"""


def placed(spark, sf_dir):
    box = F.struct("page", "x0", "y0", "x1", "y1")
    return derived(spark, sf_dir, PLACED).withColumn("boxes", F.when(F.col("kind") % 4 == 0, F.array(box, F.struct((F.col("page") + 1).alias("page"), "x0", "y0", "x1", "y1"))).otherwise(F.array(box)))


@query(f"""WITH p AS {duck(PLACED)} SELECT a.ref_id, arg_min(b.ref_id, (round(sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) ** 2 + (a.y0 - b.y0) ** 2) + CASE WHEN a.page <> b.page THEN 100000 ELSE 0 END, 6), b.ref_id)) AS nearest
    FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.ref_id <> b.ref_id GROUP BY a.ref_id""")
def nearest_reference(spark, sf_dir):
    return layout.nearest_reference(placed(spark, sf_dir))


@query(f"WITH p AS {duck(PLACED)} SELECT a.ref_id, min(b.ref_id) AS previous FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.ref_number = a.ref_number - 1 GROUP BY a.ref_id")
def previous_reference(spark, sf_dir):
    return layout.previous_reference(placed(spark, sf_dir))


@query(f"""WITH p AS (SELECT *, concat(doc_id, '/', ref_number // 2) AS g FROM {duck(PLACED)}), b AS (SELECT g, page, x0, y0, x1, y1 FROM p UNION ALL SELECT g, page + 1, x0, y0, x1, y1 FROM p WHERE kind % 4 = 0),
    u AS (SELECT g, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY g, page)
    SELECT g AS ref_id, raw, boxes, 'edited' AS status FROM (SELECT g, string_agg(raw, ' ' ORDER BY page, y0, ref_id) AS raw FROM p GROUP BY g) JOIN (SELECT g, string_agg(concat_ws(' ', page, CAST(x0 AS INT), CAST(y0 AS INT), CAST(x1 AS INT), CAST(y1 AS INT)), ';' ORDER BY page) AS boxes FROM u GROUP BY g) USING (g)""")
def merge_references(spark, sf_dir):
    """References put together by two."""
    rows = placed(spark, sf_dir)
    out = layout.merge_references(rows, rows.select("ref_id", F.concat("doc_id", F.lit("/"), F.floor(F.col("ref_number") / 2)).alias("into")))
    text = F.transform("boxes", lambda b: F.concat_ws(" ", b.page, *[b[c].cast("int") for c in ("x0", "y0", "x1", "y1")]))
    return out.select("ref_id", "raw", F.array_join(text, ";").alias("boxes"), "status")


@query(f"""WITH p AS (SELECT * FROM {duck(PLACED)} WHERE kind % 3 = 2), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ref_number, ref_id) % 2 = 1 AS l FROM p WHERE y1 + 4 < 200)
    SELECT ref_id, 'highlight' AS kind, page, x0, y0, x1, y1, raw AS text FROM p UNION ALL SELECT ref_id, 'highlight', page + 1, x0, y0, x1, y1, raw FROM p WHERE kind % 4 = 0
    UNION ALL SELECT ref_id, 'callout', page, CASE WHEN l THEN x0 ELSE x1 - 69.5 END, y1 + 4, CASE WHEN l THEN x0 + 69.5 ELSE x1 END, least(y1 + 22, 200), 'Fabricated?' FROM c""")
def decision_notes(spark, sf_dir):
    """Notes for fabricated references on pages of 200 points."""
    rows = placed(spark, sf_dir)
    pages = rows.select("doc_id", "page").distinct().withColumn("page_height", F.lit(200.0))
    return layout.decision_notes(rows, pages, "fabricated", "Fabricated?").select("ref_id", "kind", "page", "x0", "y0", "x1", "y1", "text")


@query(f"SELECT ref_id, decision, CASE WHEN decision = 'valid' THEN 'new' ELSE 'old' END AS text FROM {duck(PLACED)}")
def replace_notes(spark, sf_dir):
    notes = derived(spark, sf_dir, PLACED).select("ref_id", "decision", F.lit("old").alias("text"))
    return layout.replace_notes(notes, notes.where("decision = 'valid'").withColumn("text", F.lit("new")), "valid")


ITEMS = f"""SELECT doc_id, ref_number, kind, 1 AS page, CAST(part AS INT) AS item, CASE part WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'low' END AS text, CAST(ref_number * 100 + CASE part WHEN 0 THEN 0 WHEN 1 THEN 20 + kind % 2 * 8 ELSE 0 END AS DOUBLE) AS x0,
    CAST(CASE part WHEN 2 THEN 30 ELSE 10 END AS DOUBLE) AS y0 FROM (SELECT doc_id, ref_number, min(kind) AS kind FROM ({REFS}) AS r GROUP BY doc_id, ref_number) AS q CROSS JOIN (SELECT 0 AS part UNION ALL SELECT 1 UNION ALL SELECT 2) AS p"""


@query(f"SELECT concat(doc_id, '/', ref_number) AS box_id, CASE WHEN kind % 3 = 0 THEN 'one two low' ELSE 'one two' END AS text FROM (SELECT DISTINCT doc_id, ref_number, kind FROM {duck(ITEMS)})")
def text_in_box(spark, sf_dir):
    """A box around each reference's items; in two of three the low one lies outside. The second word of a line stands up to two
    units higher than the first."""
    items = derived(spark, sf_dir, ITEMS)
    items = items.withColumn("y0", F.col("y0") - F.when(F.col("item") == 1, F.col("kind") % 3).otherwise(0))
    boxes = items.select("doc_id", "ref_number", "kind", "page").distinct().select(
        F.concat("doc_id", F.lit("/"), "ref_number").alias("box_id"), "doc_id", "page", (F.col("ref_number") * 100.0).alias("x0"), F.lit(5.0).alias("y0"), (F.col("ref_number") * 100.0 + 60).alias("x1"), F.when(F.col("kind") % 3 == 0, 45.0).otherwise(25.0).alias("y1"),
    )
    return layout.text_in_box(items.withColumns({"x1": F.col("x0") + 18, "y1": F.col("y0") + 10}), boxes)


@query(f"SELECT doc_id, ref_number, text FROM (SELECT DISTINCT doc_id, ref_number, CASE WHEN kind % 2 = 0 THEN 'onetwo' ELSE 'one two' END AS text FROM {duck(ITEMS)} UNION ALL SELECT DISTINCT doc_id, ref_number, 'low' FROM {duck(ITEMS)})")
def group_items_into_lines(spark, sf_dir):
    """Glyph runs of one reference as one page each: a baseline of two runs and a lower one."""
    items = derived(spark, sf_dir, ITEMS).select(
        F.concat("doc_id", F.lit("/"), "ref_number").alias("doc_id"), "page", "item", "text", F.col("x0").alias("x"), (100 - F.col("y0")).alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height")
    )
    lines = layout.group_items_into_lines(items)
    return lines.select(F.split_part("doc_id", F.lit("/"), F.lit(1)).cast("bigint").alias("doc_id"), F.split_part("doc_id", F.lit("/"), F.lit(2)).cast("int").alias("ref_number"), "text")
