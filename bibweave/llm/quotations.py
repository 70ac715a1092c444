"""Quotation linking: parse nested quote levels, link quoted passages to the messages they come from, order by reply.

DataFrame functions only. A line's level is its number of leading ``>`` marks (blanks between them allowed). A passage is a
maximal run of lines of one level; its key is the hash of its lower-cased words. Each message's own passages, its whole own
text and its single own lines are indexed, one row per (conversation, key) and one per key, so a passage that a third of all
messages repeat adds one row, never pairs. A quote of several lines is also said by each message that holds all its lines
(blank ones aside), so a trimmed quote links too: its rarest line finds the distinct texts, each is checked once.

Defined results: a quote links to the first message of its conversation that says the passage, if that is earlier, else to
the first message of another conversation, else to none. Null text is empty; a null turn comes first; rows repeating
(conv_id, turn) each stay, and as a link's target they are one message. Messages of a null conversation are one conversation. A message's parent is the target of its first
quote of level 1 inside its conversation; threads follow parents to a root. Empty passages link with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibweave.session import persisted

MARKS = r"^(?:[ \t]*>)+"
BLOCK = 4096  # turns ranked together; a longer thread is ranked block by block


def _lines(messages: DataFrame) -> DataFrame:
    """Every message with its lines as (level, body) and their runs as (level, body, first line)."""
    marked = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), F.regexp_extract(x, MARKS, 0).alias("marks")))
    levelled = F.transform(
        marked,
        lambda x: F.struct(F.length(F.translate(x["marks"], " \t", "")).alias("level"), F.trim(F.substr(x["line"], F.length(x["marks"]) + 1, F.length(x["line"]))).alias("body")),
    )
    n = F.size("lines")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    after = F.concat(F.slice("first", 2, F.greatest(F.size("first") - 1, F.lit(1))), F.array(n))
    run = F.transform(
        F.arrays_zip("first", "after"),
        lambda x: F.struct(F.get("lines", x["first"])["level"].alias("level"), F.array_join(F.transform(F.slice("lines", x["first"] + 1, x["after"] - x["first"]), lambda y: y.body), "\n").alias("body")),
    )
    return messages.withColumn("lines", levelled).withColumn("first", first).withColumn("after", after).withColumn("runs", run).drop("first", "after")


def _key(body):
    words = F.trim(F.regexp_replace(F.lower(body), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(words != "", F.md5(words))


def _lines_held(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, key for each message that holds all lines of a quoted passage of two lines or more. Equal texts and equal
    passages are compared once."""
    passages = parsed.select(F.explode("quotes").alias("quote")).where("size(quote.lines) > 1").select("quote.key", "quote.lines").distinct()
    said = parsed.where("size(own_lines) > 1").select("conv_id", "turn", "own_lines", F.md5(F.array_join("own_lines", "")).alias("text_id"))
    texts = said.select("text_id", "own_lines").dropDuplicates(["text_id"])
    by_line = texts.select("text_id", F.explode("own_lines").alias("line"))
    wanted = passages.select("key", "lines", F.explode("lines").alias("line"))
    counts = by_line.join(wanted.select("line").distinct(), "line").groupBy("line").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "line", "left").groupBy("key", "lines").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "line")).alias("rarest"))
    met = rarest.where("rarest.n > 0").select("key", "lines", "rarest.line").join(by_line, "line").join(texts, "text_id")
    held = met.where(F.size(F.array_except("lines", "own_lines")) == 0).select("key", "text_id").distinct()
    return held.join(said.select("conv_id", "turn", "text_id").distinct(), "text_id").select("conv_id", "turn", "key")


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, own_text, n_quotes, max_level, n_linked, n_linked_elsewhere, reply_to,
    thread_root, thread_depth, reply_index."""
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    parsed = _lines(base)
    own = F.array_join(F.filter(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.body), lambda b: b != ""), "\n")
    line_keys = lambda body: F.array_distinct(F.filter(F.transform(F.split(body, "\n"), _key), lambda k: k.isNotNull()))
    of_level_0 = F.transform(F.filter("runs", lambda x: x.level == 0), lambda x: _key(x.body))
    parsed = parsed.withColumn("own_text", own).withColumn("own_lines", line_keys(F.col("own_text")))
    parsed = persisted(
        parsed.select(
            "conv_id", "turn", "role", "own_text",
            F.coalesce(F.array_max(F.transform("lines", lambda x: x.level)), F.lit(0)).alias("max_level"),
            F.transform(F.filter("runs", lambda x: x.level > 0), lambda x: F.struct(x.level.alias("level"), _key(x.body).alias("key"), line_keys(x.body).alias("lines"))).alias("quotes"),
            "own_lines",
            F.array_distinct(F.concat(F.array(_key(F.col("own_text"))), of_level_0, F.col("own_lines"))).alias("said"),
        ),
        "messages",
    )
    said = parsed.select("conv_id", "turn", F.explode("said").alias("key")).where("key IS NOT NULL")
    here = said.unionByName(_lines_held(parsed)).groupBy("conv_id", "key").agg(F.min("turn").alias("first_turn"))
    quoted = parsed.select("conv_id", "turn", F.posexplode("quotes").alias("nr", "quote")).select("conv_id", "turn", "nr", "quote.level", "quote.key")
    here = persisted(here, "said")
    # the first conversation that says the passage, and the first apart from that one
    first = here.where("conv_id IS NOT NULL").groupBy("key").agg(F.min("conv_id").alias("first_conv"))
    second = here.where("conv_id IS NOT NULL").join(first, (here.key == first.key) & (here.conv_id == first.first_conv), "left_anti").groupBy("key").agg(F.min("conv_id").alias("second_conv"))
    said_here = here.select(F.col("conv_id").alias("h_conv"), F.col("key").alias("h_key"), "first_turn")

    linked = (
        quoted.join(said_here, F.col("key").eqNullSafe(F.col("h_key")) & F.col("conv_id").eqNullSafe(F.col("h_conv")), "left")
        .join(first, "key", "left")
        .join(second, "key", "left")
        .select(
            "conv_id", "turn", "nr", "level",
            F.when(F.col("first_turn") < F.col("turn"), F.col("first_turn")).alias("to_turn"),
            F.when(F.col("first_conv").eqNullSafe(F.col("conv_id")), F.col("second_conv")).otherwise(F.col("first_conv")).alias("to_conv"),
        )
    )
    per_message = linked.groupBy("conv_id", "turn").agg(
        F.count_if(F.col("to_turn").isNotNull()).alias("n_linked"),
        F.count_if(F.col("to_turn").isNull() & F.col("to_conv").isNotNull()).alias("n_linked_elsewhere"),
        F.min(F.when(F.col("to_turn").isNotNull() & (F.col("level") == 1), F.struct("nr", "to_turn")))["to_turn"].alias("reply_to"),
    )
    per_message = persisted(per_message, "links")
    roots = _roots(per_message.where("reply_to IS NOT NULL").select("conv_id", "turn", "reply_to"))
    links = _same_message(per_message, roots)
    out = parsed.select("conv_id", "turn", "role", "own_text", F.size("quotes").alias("n_quotes"), "max_level")
    out = _same_message(out, links)
    out = out.withColumns(
        {
            "n_linked": F.coalesce("n_linked", F.lit(0)),
            "n_linked_elsewhere": F.coalesce("n_linked_elsewhere", F.lit(0)),
            "thread_root": F.coalesce("thread_root", "turn"),
            "thread_depth": F.coalesce("thread_depth", F.lit(0)),
            "block": F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK),
        }
    )
    # place in the thread: rank in a block of turns plus the sizes of the blocks before
    sizes = out.groupBy("conv_id", "thread_root", "block").agg(F.count("*").alias("size"))
    before = sizes.select("conv_id", "thread_root", "block", (F.sum("size").over(Window.partitionBy("conv_id", "thread_root").orderBy("block")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "thread_root", "block").orderBy("turn", "role", "own_text"))
    return (
        out.withColumn("place", place)
        .alias("o")
        .join(before.alias("b"), F.expr("o.conv_id <=> b.conv_id AND o.thread_root <=> b.thread_root AND o.block <=> b.block"))
        .selectExpr("o.conv_id", "o.turn", "o.role", "o.own_text", "o.n_quotes", "o.max_level", "o.n_linked", "o.n_linked_elsewhere", "o.reply_to", "o.thread_root", "o.thread_depth", "o.place + b.before AS reply_index")
    )


def _same_message(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by (conv_id, turn); nulls are equal."""
    right = right.withColumnsRenamed({"conv_id": "r_conv", "turn": "r_turn"})
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("r_conv")) & F.col("turn").eqNullSafe(F.col("r_turn")), "left").drop("r_conv", "r_turn")


def _roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread_root, thread_depth by pointer doubling: each pass doubles the distance, so a chain of n replies
    takes log2(n) joins, and only messages that have not met their root yet go into the next one. A parent is always
    earlier, so there are no cycles."""
    at = persisted(replies.select("conv_id", "turn", F.col("reply_to").alias("thread_root"), F.lit(1).cast("long").alias("thread_depth"), F.lit(True).alias("open")), "replies")
    while at.where("open").limit(1).count():
        up = at.select(F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("thread_root").alias("higher"), F.col("thread_depth").alias("more"))
        step = at.where("open").join(up, F.col("conv_id").eqNullSafe(F.col("up_conv")) & (F.col("thread_root") == F.col("up_turn")), "left")
        step = step.select("conv_id", "turn", F.coalesce("higher", "thread_root").alias("thread_root"), (F.col("thread_depth") + F.coalesce("more", F.lit(0))).alias("thread_depth"), F.col("higher").isNotNull().alias("open"))
        at = persisted(at.where("NOT open").unionByName(step), "threads")
    return at.drop("open")
