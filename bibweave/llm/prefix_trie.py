"""Conversation prefix trie: the tree of all beginnings of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of turns (role, text) from the start; its members are the conversations that start with it. The
smallest member and the depth name it: a conversation has one node at each depth.

1. Turns get their place from a range-partitioned sort: places within a partition's share of a conversation, plus the sizes of
   the shares before it. A conversation may hold any part of the rows.
2. A prefix is named by its depth and two exact sums of 64-bit hashes of (place, role, text), so prefixes follow from running
   sums, in blocks of ``BLOCK`` turns. Texts don't travel beyond the sort: what goes on is two hashes and a length.
3. Nodes and edges are grouped rows. The tree is contracted in rounds: rake removes all leaves and adds their totals to their
   parents; compress splices out nodes with one child left, those whose depth has the round's bit, unless the child goes too.
   Every node keeps the number of its children and the exclusive or of their names: of an only child that is its name, so no
   join meets a parent with many children. A chain of n nodes takes log2(n) rounds.
4. The spliced nodes are put back in reverse, their totals being what lay on the edge plus their child's total.

Defined results: rows without a conv_id name no conversation and are left out. Null role and text are empty strings. Turns
are ordered by turn (null first), ties by role and text; repeated rows are turns of their own. Further columns don't matter.
An empty table gives no rows; otherwise the root is there, with all conversations as members.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibweave.session import persisted

BLOCK = 1024
KEY = ["conv_id", "depth"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Ids of a node that are joined to one row before they are hashed.
IDS = 8192


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a, b (hashes of role and text), size (code points), one row per turn."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first()).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    # the sort is followed by a write: neither the deal nor the numbers are made twice
    dealt = dealt.select(
        "conv_id", F.spark_partition_id().alias("share"), F.monotonically_increasing_id().alias("at"),
        F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b"), F.length("text").alias("size"),
    )
    dealt = persisted(dealt, "turns")
    shares = dealt.groupBy("conv_id", "share").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select("conv_id", "share", (before - F.col("first") + 1).alias("shift"))
    return dealt.join(shares, ["conv_id", "share"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "a", "b", "size")


def rebuilt_turns(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and their lengths (conv_id, length).

    With h = crc32(decimal conv_id) % most, a conversation opens with the first h turns of the first of its family (conv_id -
    conv_id % family) and goes on with its own after the first h. An opening has fewer than ``most`` turns and meets the
    conversations of one family.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % most
    plan = own.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    lengths = plan.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lent = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    plan = persisted(lengths.select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    openings = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    borrowed = openings.join(plan.select("base", "conv_id", "lent"), "base").where(F.col("place") <= F.col("lent"))
    rest = turns.where(F.col("conv_id") % family != 0).join(plan.select("conv_id", "h", "lent"), "conv_id").where(F.col("place") > F.col("h"))
    kept = turns.where(F.col("conv_id") % family == 0).join(plan.select("conv_id", F.col("h").alias("mine")), "conv_id").where(F.col("place") > F.col("mine"))
    columns = ["conv_id", "place", "a", "b", "size"]
    moved = rest.withColumn("place", F.col("place") - F.col("h") + F.col("lent"))
    return borrowed.select(columns).unionByName(moved.select(columns)).unionByName(kept.select(columns)), plan.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, size, the sums (x, y) that name the prefix ending here, and (px, py) those of the prefix before it."""
    whole = lambda c: c.cast("decimal(20,0)")
    marked = turns.select("conv_id", "place", "size", whole(F.xxhash64("place", "a", "b")).alias("dx"), whole(F.xxhash64("b", "place", "a")).alias("dy"))
    marked = marked.withColumn("block", F.expr(f"(place - 1) div {BLOCK}"))
    block = marked.groupBy("conv_id", "block").agg(F.sum("dx").alias("bx"), F.sum("dy").alias("by"))
    along = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = block.withColumns({"ox": F.sum("bx").over(along), "oy": F.sum("by").over(along)}).where("block > 0").select("conv_id", "block", "ox", "oy")
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = marked.withColumns({"x": F.sum("dx").over(inside), "y": F.sum("dy").over(inside)}).join(before, ["conv_id", "block"], "left")
    exact = lambda s, o: (F.col(s) + F.coalesce(F.col(o), F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)")
    run = run.withColumns({"x": exact("x", "ox"), "y": exact("y", "oy")})
    return run.select("conv_id", "place", "size", "x", "y", (F.col("x") - F.col("dx")).cast("decimal(38,0)").alias("px"), (F.col("y") - F.col("dy")).cast("decimal(38,0)").alias("py"))


def trie_nodes(conversations: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, size) and where conversations end (conv_id, depth of the node, ended)."""
    turns, lengths = rebuilt_turns(ordered_turns(conversations), family, most)
    rows = persisted(prefixes(turns), "prefixes")
    named = rows.groupBy(F.col("place").alias("depth"), "x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.first("px").alias("px"), F.first("py").alias("py")
    )
    named = persisted(named, "named")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = persisted(root, "root")
    above = named.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "size"]
    deep = named.where("depth > 1").join(above, ["depth", "px", "py"]).select(columns)
    first = named.where("depth = 1").join(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id")))).select(columns)  # the root is one row
    top = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).alias("size"))
    nodes = persisted(top.unionByName(first).unionByName(deep), "nodes")
    last = rows.join(lengths.withColumnRenamed("length", "place"), ["conv_id", "place"]).select(F.col("place").alias("depth"), "x", "y", F.col("conv_id").alias("ended"))
    ends = last.join(named.select("depth", "x", "y", "conv_id"), ["depth", "x", "y"]).select("conv_id", "depth", "ended")
    turnless = lengths.where("length = 0").select(F.col("conv_id").alias("ended")).join(F.broadcast(root.select("conv_id")))
    return nodes, ends.unionByName(turnless.select("conv_id", F.lit(0).cast("long").alias("depth"), "ended"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition to (conv_id, depth, first, ids): up to ``IDS`` ids of a node in one string."""

    def part(key, ids):
        return pa.RecordBatch.from_pylist([{"conv_id": key[0], "depth": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}])

    key, held = None, []
    for batch in batches:
        for c, d, ended in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and ((c, d) != key or len(held) == IDS):
                yield part(key, held)
                held = []
            key = (c, d)
            held.append(ended)
    if held:
        yield part(key, held)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts of whole nodes to (conv_id, depth, sha): one running hash, a part at a time."""
    rows = ((c, d, ids) for b in batches for c, d, _, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
    for (c, d), parts in itertools.groupby(rows, lambda r: r[:2]):
        sha, comma = hashlib.sha256(), b""
        for *_, ids in parts:
            sha.update(comma + ids.encode())
            comma = b","
        yield pa.RecordBatch.from_pylist([{"conv_id": c, "depth": d, "sha": sha.hexdigest()}])


def end_hashes(ends: DataFrame) -> DataFrame:
    """conv_id, depth, sha of the ascending ids that end at the node.

    A hash over a list is one running state, so its bytes pass one task in the end; the ids are sorted and joined to strings by
    range before that, in many tasks, and no task holds a node's ids at once."""
    dealt = ends.repartitionByRange(*KEY, "ended").sortWithinPartitions(*KEY, "ended")
    parts = dealt.mapInArrow(_joined_ids, "conv_id long, depth long, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, "conv_id long, depth long, sha string")


def _notes(out: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """What spliced nodes tell others, one row per node told: the child its new parent and edge, the parent its new child, and
    themselves that they are gone."""
    said = F.array(
        F.struct(
            F.col("to_conv_id").alias("conv_id"), F.col("to_depth").alias("depth"), F.col("parent_conv_id").alias("new_conv_id"), F.col("parent_depth").alias("new_depth"),
            *[(F.col(s) + F.col(f"edge_{s}")).alias(f"set_{s}") for s in sums], F.lit(False).alias("dropped"), F.lit(0).cast("long").alias("flip_c"), F.lit(0).cast("long").alias("flip_d"),
        ),
        F.struct(
            F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth"), F.lit(None).cast("long").alias("new_conv_id"), F.lit(None).cast("long").alias("new_depth"),
            *[F.lit(None).cast("long").alias(f"set_{s}") for s in sums], F.lit(False).alias("dropped"),
            F.col("conv_id").bitwiseXOR(F.col("to_conv_id")).alias("flip_c"), F.col("depth").bitwiseXOR(F.col("to_depth")).alias("flip_d"),
        ),
        F.struct(
            F.col("conv_id"), F.col("depth"), F.lit(None).cast("long").alias("new_conv_id"), F.lit(None).cast("long").alias("new_depth"),
            *[F.lit(None).cast("long").alias(f"set_{s}") for s in sums], F.lit(True).alias("dropped"), F.lit(0).cast("long").alias("flip_c"), F.lit(0).cast("long").alias("flip_d"),
        ),
    )
    rows = out.select(F.inline(said))
    once = [F.max(c).alias(c) for c in ("new_conv_id", "new_depth", *[f"set_{s}" for s in sums], "dropped")]
    return rows.groupBy(*KEY).agg(*once, F.bit_xor("flip_c").alias("flip_c"), F.bit_xor("flip_d").alias("flip_d"))


def contract(tree: DataFrame, sums: tuple[str, ...]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of rake and compress over the nodes conv_id, depth, parent_conv_id, parent_depth, and a value column per name of
    ``sums``. Gives the raked nodes of every round, with their subtree totals, and the spliced nodes of every round, with their
    child (to_conv_id, to_depth) and what they have beyond its total."""
    below = tree.where("parent_depth IS NOT NULL").select(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth"), F.col("conv_id").alias("c"), F.col("depth").alias("d"))
    edges = below.groupBy(*KEY).agg(F.count("*").alias("k"), F.bit_xor("c").alias("xc"), F.bit_xor("d").alias("xd"))
    zero = {f"edge_{s}": F.lit(0).cast("long") for s in sums}
    alive = persisted(tree.join(edges, KEY, "left").na.fill(0, ["k", "xc", "xd"]).withColumns(zero), "alive")
    bits = max(1, int(alive.agg(F.max("depth")).first()[0] or 0).bit_length())
    up = [F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth")]
    raked, spliced = [], []
    for step in itertools.count():
        # rake
        leaves = alive.where("k = 0")
        raked.append(leaves.select(*KEY, *sums))
        given = leaves.where("parent_depth IS NOT NULL").groupBy(*up).agg(
            F.count("*").alias("gone"), F.bit_xor("conv_id").alias("gone_c"), F.bit_xor("depth").alias("gone_d"), *[F.sum(F.col(s) + F.col(f"edge_{s}")).alias(f"in_{s}") for s in sums]
        )
        rest = alive.where("k > 0").join(given, KEY, "left")
        none = F.lit(0).cast("long")
        new = {"k": F.col("k") - F.coalesce("gone", none), "xc": F.col("xc").bitwiseXOR(F.coalesce("gone_c", none)), "xd": F.col("xd").bitwiseXOR(F.coalesce("gone_d", none))}
        new |= {s: F.col(s) + F.coalesce(f"in_{s}", none) for s in sums}
        rest = persisted(rest.withColumns(new).select(*alive.columns), "raked")
        # compress
        chosen = (F.col("k") == 1) & F.col("parent_depth").isNotNull() & (F.shiftright("depth", step % bits) % 2 == 1)
        child = rest.where(~F.coalesce(chosen, F.lit(False))).select(F.col("conv_id").alias("xc"), F.col("depth").alias("xd"), *[F.col(f"edge_{s}").alias(f"to_{s}") for s in sums])
        out = rest.where(chosen).join(child, ["xc", "xd"])
        out = out.select(*KEY, "parent_conv_id", "parent_depth", F.col("xc").alias("to_conv_id"), F.col("xd").alias("to_depth"), *[(F.col(s) + F.col(f"to_{s}")).alias(s) for s in sums], *[F.col(f"edge_{s}") for s in sums])
        out = persisted(out, "spliced")
        spliced.append(out.select(*KEY, "to_conv_id", "to_depth", *sums))
        after = rest.join(_notes(out, sums), KEY, "left").where("dropped IS NULL OR NOT dropped")
        moved = F.col("new_depth").isNotNull()
        new = {"parent_conv_id": F.when(moved, F.col("new_conv_id")).otherwise(F.col("parent_conv_id")), "parent_depth": F.coalesce("new_depth", "parent_depth")}
        new |= {"xc": F.col("xc").bitwiseXOR(F.coalesce("flip_c", none)), "xd": F.col("xd").bitwiseXOR(F.coalesce("flip_d", none))}
        new |= {f"edge_{s}": F.when(moved, F.col(f"set_{s}")).otherwise(F.col(f"edge_{s}")) for s in sums}
        alive = persisted(after.withColumns(new).select(*alive.columns), "alive")
        if alive.isEmpty():
            return raked, spliced


def subtree_totals(tree: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """conv_id, depth and the sum of every value column over the node's subtree. See ``contract``."""
    raked, spliced = contract(tree, sums)
    later = raked[-1]
    for leaves, out in zip(reversed(raked[:-1]), reversed(spliced[:-1]), strict=True):
        if not out.isEmpty():
            below = later.select(F.col("conv_id").alias("to_conv_id"), F.col("depth").alias("to_depth"), *[F.col(s).alias(f"to_{s}") for s in sums])
            back = out.join(below, ["to_conv_id", "to_depth"]).select(*KEY, *[(F.col(s) + F.col(f"to_{s}")).alias(s) for s in sums])
            back = persisted(back, "expanded")
            later = later.unionByName(back)
        later = later.unionByName(leaves)
    return later


def prefix_trie(conversations: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, ends = trie_nodes(conversations, family, most)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = persisted(nodes.join(children, KEY, "left").na.fill(0, ["n_children"]), "grown")
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("size").cast("long")
    tree = nodes.select(*KEY, "parent_conv_id", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("parent_depth"), leaf.alias("n_leaves"), saved.alias("saved_tokens"))
    found = nodes.join(subtree_totals(tree, ("n_leaves", "saved_tokens")), KEY).join(end_hashes(ends), KEY, "left")
    return found.select(*KEY, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
