"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources by code point (null last) take the given weights in turn and share a budget of words; a source's target stops at
``most`` times its size and the excess is shared again by weight. Of a source whose target holds k complete epochs, every
document is taken k times; the fraction left goes to the documents with the smallest keys -ln(u) / w, where u is a hash of
the row and w its quality weight, up to the prefix sum nearest the fraction. ``weigh`` makes the weight from the text (the
queries pass the quality classifier's score); by default it is the share of characters that aren't marks of junk.

A source may hold any share of the rows: sizes are summed over cells of the key's range, the prefix sums of these sums find
the cell in which a source's budget ends, and that cell is cut again until few rows are in it; only these are sorted. What a
row takes then depends on its own key and its source's cut alone. One row per source meets in one task.

Defined results: null text has size 0; a document of size 0 is never taken; rows that are equal in id and text share their
key and are taken together (ties: by key, then by a second hash). Documents of null id take part like others. With no words at all every target is 0. Extra
columns are kept by ``mix`` and don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from bibweave.llm.wordbytes import pieces, word_counts
from bibweave.session import persisted

WEIGHTS = (5.0, 2.0, 1.0)


@F.arrow_udf(LongType())
def n_words(text: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    return pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(word_counts(part.column(0)) for part in pieces(batch, "text"))]), pa.int64())


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: the share of characters that aren't the marks of generated junk, to the fourth power."""
    junk = F.length(text) - F.length(F.translate(text, "%$&*#!|{}<>=_~^", ""))
    share = 1 - junk / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), F.coalesce(F.pow(share, F.lit(4)), F.lit(0.05)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target of a table source, source_size. With every share below its cap, shares are L w; sources
    reach their caps in the order of cap / w, so L follows from prefix sums over the sources."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((order - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": F.col("source_size") * most, "goal": F.sum("source_size").over(everything) * budget, "all_weights": F.sum("weight").over(everything)})
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    full = ranked.withColumns({"caps": F.sum("cap").over(by) - F.col("cap"), "used": F.sum("weight").over(by) - F.col("weight")})
    # the level if this source and all after it stay below their caps; the first for which that is true sets it
    full = full.withColumn("level", (F.col("goal") - F.col("caps")) / (F.col("all_weights") - F.col("used")))
    full = full.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct("caps", "used", "level"))).over(everything)
    full = full.withColumn("least", level)
    return full.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("least.level") * F.col("weight"), F.col("cap"))).alias("target"))


def _row_key(ident: Column, text: Column, weight: Column, seed: int) -> Column:
    """In the order of E = -ln(u) / w, exponential with rate w: ln E, scaled to [0, 1). On this scale the keys of any weight
    spread over many parts of the range."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident, text), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return (F.ln(-F.ln(u) / F.greatest(weight, F.lit(1e-3))) + 40) / 52


def _meet(a: DataFrame, b: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls meet; the columns of a stay."""
    fresh = b.select(*[F.col(c).alias(f"_{c}") for c in cols], *[c for c in b.columns if c not in cols])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]
    return a.join(fresh, same, how).drop(*[f"_{c}" for c in cols])


def _cuts(light: DataFrame, targets: DataFrame, buckets: int, enough: int) -> DataFrame:
    """source, epochs and the last key (key, tie) taken in the fraction; null where none is.

    The range of the keys is cut into ``buckets`` cells, the cell in which a source's budget ends is cut again, and so on until
    at most ``enough`` rows are in it (or five times: cells of 2^-50). Only these rows are sorted.
    """
    goal = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select("source", "epochs", "rest")
    inside = _meet(light.where("size > 0"), goal.where("rest > 0").select("source", F.col("rest").alias("left")), ["source"])
    for level in range(1, 6):
        inside = inside.withColumn("cell", F.floor(F.col("key") * float(buckets**level)))
        sums = inside.groupBy("source", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.first("left").alias("left"))
        along = Window.partitionBy("source").orderBy("cell")
        sums = sums.withColumns({"before": F.sum("size").over(along) - F.col("size"), "last": F.lead("cell").over(along).isNull()})
        ends = sums.where((F.col("before") < F.col("left")) & ((F.col("before") + F.col("size") >= F.col("left")) | F.col("last")))
        ends = persisted(ends.select("source", "cell", "rows", (F.col("left") - F.col("before")).alias("left")), "ends")
        inside = _meet(inside.drop("left"), ends.select("source", "cell", "left"), ["source", "cell"])
        if (ends.agg(F.max("rows")).first()[0] or 0) <= enough:
            break
    last = inside.groupBy("source", "key", "tie", "left").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("key", "tie")
    upto = last.withColumn("upto", F.sum("size").over(order))
    # a row that crosses the budget is taken where that comes nearer to it
    taken = upto.where((F.col("upto") <= F.col("left")) | ((F.col("upto") - F.col("size") < F.col("left")) & (F.col("upto") - F.col("left") < F.col("left") - (F.col("upto") - F.col("size")))))
    at = taken.groupBy("source").agg(F.max(F.struct("key", "tie")).alias("cut"))
    # no row of the last cell taken: the cut lies before that cell
    start = ends.select("source", F.struct((F.col("cell") / float(buckets**level)).alias("key"), F.lit(-(2**63)).alias("tie")).alias("start"))
    cut = _meet(_meet(goal, at, ["source"], "left"), start, ["source"], "left")
    return cut.select("source", "epochs", F.coalesce("cut", "start").alias("cut"))


def _planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weigh: Callable[[Column], Column] | None = None, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.0, most: float = 3.0, seed: int = 17, buckets: int = 1024, enough: int = 1 << 16) -> DataFrame:
    """docs with its columns named c0, c1, ... and size, source_size, target, copies."""
    names = docs.columns
    fresh = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text, source = (F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col))
    keyed = fresh.withColumns({"source": source, "size": n_words(text), "key": _row_key(ident, text, (weigh or quality_weight)(text), seed), "tie": F.xxhash64(ident, text)})
    light = persisted(keyed.select("source", "size", "key", "tie"), "sizes")
    targets = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    targets = persisted(targets, "targets")
    cuts = _cuts(light, targets, buckets, enough)
    plan = persisted(_meet(targets, cuts, ["source"]), "plan")
    out = _meet(keyed, plan, ["source"])
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.when(F.struct("key", "tie") <= F.col("cut"), 1).otherwise(0)).otherwise(0)
    return out.select(*fresh.columns, "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target, mix_copies. Words taken: mix_size * mix_copies."""
    added = ["size", "source_size", "target", "copies"]
    return _planned(docs, **options).toDF(*docs.columns, *[f"mix_{c}" for c in added])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    rows = _planned(docs, **options).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
