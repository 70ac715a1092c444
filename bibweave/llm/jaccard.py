"""N-gram Jaccard join: groups of documents linked by word-shingle sets of Jaccard similarity t or more (exact).

Method. Every distinct shingle is hashed into one of G groups; a document is the point of its group counts. For two sets the
overlap is at most the sum of the coordinate minima, so an R-tree over the points, whose boxes bound that sum from above,
yields the pairs that can still reach t; those are verified on the sets themselves.

A tree over all documents cannot be one task's work, so Spark first brings together what can link, losing nothing:

1. Equal sets are one class (a group of copies of any size is one row from here on).
2. Screen: of the first (1.1 - t) n shingles of its set in hash order, a linked class shares at least 0.1 n with other
   classes. Others are alone.
3. Of the rest, shingles are ordered from rare to frequent. Linked classes share one of their first n - ceil(t n) + 1, so the
   components over these shared keys (label propagation in Spark) hold every link.
4. Each component is cut into tiles of at most ``tile`` classes; every pair of tiles is one group of ``applyInArrow``: R-tree
   search, then verification, of the pairs not connected so far. It returns only the edges that connect (fewer than its
   classes), never pairs of a clique. Components of these edges are the result.

Defined results: null and empty texts have 0 shingles and are alone; fewer words than a shingle make one shingle of the whole
sequence. component_id is the smallest id reachable; null ids are larger than others (a component of null ids has a null
component_id). Rows repeating an id each count as a document. Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibweave.llm.wordbytes import hashed_words, mixed, pieces
from bibweave.session import persisted

MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93]
GROUPS = 64  # at least; see group_points
LEAF = 32
AT_ONCE = 64  # pairs verified together


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = hashed_words(column)
    mix = [np.uint64(MIX[k % 8]) * np.uint64(1) if k < 8 else mixed(np.array([k], dtype=np.uint64))[0] for k in range(words)]
    rolled = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled += h[k : k + len(rolled)] * mix[k]
    rolled = mixed(rolled)
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif n:
            whole = np.zeros(1, dtype=np.uint64)
            for k in range(n):
                whole += h[a + k : a + k + 1] * mix[k]
            yield mixed(whole + np.uint64(n))
        else:
            yield rolled[:0]


def _keep(n: int, percent: int) -> int:
    """The least overlap with any set that a set of n needs: ceil(t n)."""
    return -(-percent * n // 100)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=sizes[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64)))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two 64-bit digests of each set; equal sets, equal digests."""
    x = np.array([np.bitwise_xor.reduce(s) for s in sets], dtype=np.uint64)
    y = np.array([mixed(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))]


def _outline(words: int, share: float):
    """Per document: size and digests of its set, and the first shingles in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = list(shingle_sets(part.column("text"), words))
                first = _lists([s[: math.ceil(share * len(s))] for s in sets])
                keys = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(part.column, keys), *_digests(sets), first], [*keys, "n", "x", "y", "first"])

    return run


def _full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = list(shingle_sets(part.column(0), words))
                n, x, y = _digests(sets)
                yield pa.RecordBatch.from_arrays([n, x, y, _lists(sets)], ["n", "x", "y", "grams"])

    return run


class RTree:
    """Packed R-tree over group-count points: leaves of LEAF points, parents of 16 boxes. A box keeps, besides the upper
    corner, the least and largest set size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, : points.shape[1] // 2].sum(axis=1), sizes))  # packing: by size, then along a coordinate sum
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, small, large, fan = self.points, self.sizes, self.sizes, LEAF
        while len(high) > 1 or not self.levels:
            at = np.arange(0, len(high), fan)
            high, small, large = np.maximum.reduceat(high, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            self.levels.append((high, small, large, fan))
            fan = 16

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose set size and overlap bound allow the similarity: (1 + t) overlap >= t (sum of sizes)."""

        def allowed(high, small, large):
            least = np.maximum(small, _keep(size, percent))
            fits = (100 * large >= percent * size) & (percent * small <= 100 * size)
            return fits & ((100 + percent) * np.minimum(high, point).sum(axis=1) >= percent * (size + least))

        rows = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, small, large, fan = self.levels[depth]
            rows = rows[allowed(high[rows], small[rows], large[rows])]
            below = len(self.points) if depth == 0 else len(self.levels[depth - 1][0])
            rows = (rows[:, None] * fan + np.arange(fan)).ravel()
            rows = rows[rows < below]
        sizes = self.sizes[rows]
        return self.order[rows[allowed(self.points[rows], sizes, sizes)]]


def group_points(grams: list[np.ndarray]) -> np.ndarray:
    """The group counts of sets. The number of groups grows with the sets (a quarter of their mean size, a power of two, GROUPS
    at least), so that the minima of unrelated long sets fall short too; the counts then take no more room than the sets."""
    mean = sum(map(len, grams)) // max(1, len(grams))
    bits = max(GROUPS.bit_length() - 1, (mean // 4).bit_length())
    points = np.zeros((len(grams), 1 << bits), dtype=np.int32)
    for i, g in enumerate(grams):
        points[i] = np.bincount((g >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return points


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of a sorted set with each of others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    begin = np.concatenate(([0], np.cumsum([len(g) for g in others])[:-1]))
    return np.add.reduceat((one[at] == flat).astype(np.int64), begin)


def tile_edges(grams: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect the linked rows of two tiles (side 0 and 1; all in one where every side is 0). Only pairs that the tree
    leaves, and that no edge connects yet, are verified."""
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    points = group_points(grams)
    parent = list(range(len(grams)))
    edges = []
    two = bool(side.any())
    inner = np.flatnonzero(side == 1) if two else np.arange(len(grams))
    outer = np.flatnonzero(side == 0) if two else inner
    tree = RTree(points[inner], sizes[inner])
    for a in outer:
        found = inner[tree.search(points[a], int(sizes[a]), percent)]
        found = found if two else found[found > a]
        for at in range(0, len(found), AT_ONCE):
            mine = _root(parent, a)
            near = [b for b in found[at : at + AT_ONCE].tolist() if _root(parent, b) != mine]
            if not near:
                continue
            both = overlaps(grams[a], [grams[b] for b in near])
            for b in np.array(near)[100 * both >= percent * (sizes[a] + sizes[near] - both)].tolist():
                x, y = _root(parent, a), _root(parent, b)
                if x != y:
                    parent[y] = x
                    edges.append((int(a), b))
    return edges


def _tile_join(percent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, tiles = group.column("node").to_pylist(), group.column("tile").to_numpy()
        lists = group.column("grams").chunk(0) if group.num_rows else []
        grams = [np.asarray(x.values).view(np.uint64) for x in lists]
        side = (tiles != tiles.min()).astype(np.int8)
        found = tile_edges(grams, side, percent)
        return pa.table({"a": pa.array([nodes[a] for a, _ in found], pa.int64()), "b": pa.array([nodes[b] for _, b in found], pa.int64())})

    return run


HOT = 2048  # a key of more than 1 / HOT of all rows is dealt over SALTS tasks; fewer than HOT keys can be
SALTS = 32


def dealt_join(rows: DataFrame, groups: DataFrame, key: str, count: str = "c") -> DataFrame:
    """rows joined with ``groups``, an aggregate of them with one row per key and its number of rows. The rows of a hot key are
    dealt over SALTS tasks by their hash, its one group row is copied to each. The list of hot keys is bounded by HOT."""
    groups = persisted(groups, "groups")
    total = groups.agg(F.sum(count).alias("_total"))  # one row
    hot = F.broadcast(groups.join(F.broadcast(total)).where(F.col(count) * HOT > F.col("_total")).select(F.col(key).alias("_hot")))
    marked = lambda df, salt: df.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    is_hot = F.col("_hot").isNotNull()
    left = marked(rows, F.when(is_hot, F.pmod(F.xxhash64(*[c for c in rows.columns if c != "grams"]), F.lit(SALTS)).cast("int")).otherwise(0))
    right = marked(groups, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.drop(count), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of an edge table a, b, by alternating large-star and small-star steps. A hub's
    neighbours are aggregated map-side and dealt over tasks (``dealt_join``), so no task holds a whole component."""
    at = persisted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = at.union(at.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).select("a", F.least("a", "m").alias("m"), "c")
        large = dealt_join(both, least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        up = persisted(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        low = up.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = dealt_join(up, low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("x"), "m").where("x <> m")
        new = persisted(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "edges")
        old, now = (d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (at, new))
        at = new
        if old == now:
            return at.select(F.col("b").alias("node"), F.col("a").alias("label"))


def linked_classes(texts: DataFrame, words: int = 5, percent: int = 80, tile: int = 1024, tile_shingles: int = 1 << 20, keyed: bool = False) -> DataFrame:
    """id, n, node, label, component of a table id, text (and k1, k2 where ``keyed``), a row for each of its rows: the size of its
    set, its class of equal sets, the class's component and the smallest id in it."""
    slack = 1 - percent / 100
    share = min(1.0, slack + 0.1)
    node = F.xxhash64("n", "x", "y")
    outline = persisted(texts.mapInArrow(_outline(words, share), f"id long, {'k1 long, k2 long, ' if keyed else ''}n long, x long, y long, first array<long>"), "outline")

    # screen; ids that stand for two classes (repeated ids) or for none (nulls) only make it pass more
    classes = outline.where("n > 0").groupBy("n", "x", "y").agg(F.min("id").alias("id"), F.any_value("first").alias("first"))
    keys = classes.select("id", "n", F.explode("first").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    counted = keys.join(shared, "key", "left_semi").groupBy("id").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    likely = persisted(counted.where(F.col("c") >= F.ceil((share - slack) * F.col("n") - 1e-6)).select(F.col("id").alias("likely")), "likely")

    chosen = texts.join(likely, F.col("id").eqNullSafe(F.col("likely")), "left_semi").select("text")
    sets = chosen.mapInArrow(_full(words), "n long, x long, y long, grams array<long>").where("n > 0")
    sets = persisted(sets.withColumn("node", node).groupBy("node", "n").agg(F.any_value("grams").alias("grams")), "sets")

    # keys from rare to frequent; those that no other set has come first and link nothing
    grams = sets.select("node", "n", F.explode("grams").alias("key"))
    often = grams.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    ranked = grams.join(often, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("common"))
    width = F.size("common") - F.ceil(F.col("n") * (percent / 100) - 1e-6) + 1
    ranked = ranked.withColumn("width", width.cast("int")).where("width > 0")
    blocks = persisted(ranked.select("node", F.explode(F.expr("transform(slice(common, 1, width), s -> s.key)")).alias("key")), "blocks")
    hubs = blocks.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    joint = components(dealt_join(blocks, hubs, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")))

    cells = joint.union(joint.select(F.col("label").alias("node"), "label").distinct())
    placed = sets.join(cells, "node")
    counts = placed.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / tile_shingles)).cast("int").alias("tiles"), F.count("*").alias("c"))
    placed = dealt_join(placed, counts, "label").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))
    pairs = placed.select(
        "label", "node", "grams", "tile",
        F.explode(F.expr("transform(sequence(0, tiles - 1), t -> struct(least(t, tile) AS i, greatest(t, tile) AS j))")).alias("at"),
    ).select(F.xxhash64("label", "at.i", "at.j").alias("deal"), "label", "at.i", "at.j", "node", "tile", "grams")
    # dealt by the pair of tiles: grouping by the label's columns alone would keep its pairs where the join put the label
    pairs = pairs.groupBy("deal", "label", "i", "j")
    linked = components(pairs.applyInArrow(_tile_join(percent), "a long, b long"))

    ids = outline.where("n > 0").groupBy(node.alias("node")).agg(F.min("id").alias("least_id"))
    label = ids.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = label.groupBy("label").agg(F.min("least_id").alias("component"))
    found = label.join(least, "label").select("node", "label", "component")
    return outline.select("id", *(["k1", "k2"] if keyed else []), "n", F.when(F.col("n") > 0, node).alias("node")).join(found, "node", "left")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Options: those of ``linked_classes``."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = linked_classes(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), **options)
    return found.select(F.col("id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, without near copies: one row of each component stays, the one with the smallest id (nulls
    last), of equal ids the one with the smallest row hash. Rows without words all stay. Rows are told apart by 128 bits of id and
    text, not by the id: another row that repeats a dropped row's id stays. Of rows equal in both, any one stays."""
    names = docs.columns
    fresh = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    keyed = fresh.withColumns({f"k{i}": F.xxhash64(F.lit(i), ident, text) for i in (1, 2)})
    found = persisted(linked_classes(keyed.select(ident.cast("long").alias("id"), text.alias("text"), "k1", "k2"), keyed=True, **options).where("n > 0").select("id", "k1", "k2", "label"), "rows")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    kept = found.groupBy("label").agg(F.min(rank).alias("kept"), F.count("*").alias("c"))
    kept = kept.where("c > 1").select("label", "c", F.col("kept.k1").alias("kept1"), F.col("kept.k2").alias("kept2"))
    members = persisted(dealt_join(found, kept, "label"), "members")
    same = (F.col("k1") == F.col("kept1")) & (F.col("k2") == F.col("kept2"))
    dropped = members.where(~same).select("k1", "k2").distinct()
    repeated = persisted(members.where(same).groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").select("k1", "k2"), "repeated")
    left = keyed.join(dropped, ["k1", "k2"], "left_anti")
    if repeated.limit(1).count():
        left = left.join(repeated, ["k1", "k2"], "left_anti").unionByName(left.join(repeated, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return left.select(*fresh.columns).toDF(*names)
