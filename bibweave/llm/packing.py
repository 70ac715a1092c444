"""Best-fit packing of token pieces into sequences by large-item matching.

A document's ids and its end id are cut, only where they exceed the capacity, into pieces of exactly the capacity after a
shorter first one. Pieces above a third of the capacity share a sequence with at most one other such piece: from the largest
down, each is matched with the largest that still fits. The smaller ones, from the largest down, go to the tightest gap that
holds them.

The plan needs only how many pieces of each length there are (at most ``capacity`` numbers, whatever the table's size): the
driver places lengths in bulk, as runs of equal pieces into runs of equal sequences. Spark then numbers the pieces of each
length (a length may be hot: rows are numbered in buckets of bounded size and shifted by the counts of the buckets before)
and every piece finds its run by its number.

Defined results: null text is empty and packs its end id alone. Rows that repeat an id are documents of their own. Extra
columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibweave.llm.bpe import encoder
from bibweave.llm.wordbytes import pieces as slices
from bibweave.session import persisted


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = enc.encode(part.column(1))
                rows, number, start, length, crc, ids = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity
                    edges = [0, *range(first or capacity, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                        if with_ids:
                            ids.append(own[a:b].astype(np.int64))
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    return run


def plan_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, end number, first sequence, offset): pieces of a length numbered from the first to the end
    go to consecutive sequences at one offset."""
    left = {s: n for s, n in counts.items() if n}
    given = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number of them)
    open_gaps: list[int] = []
    bins = 0

    def place(size: int, n: int, first: int, offset: int) -> None:
        runs.append((size, given[size], given[size] + n, first, offset))
        given[size] += n
        left[size] -= n

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            partner = next((t for t in reversed(large[: bisect_left(large, capacity - size + 1)]) if t <= size and left[t] >= 1 + (t == size)), None)
            n = left[size] if partner is None else left[size] // 2 if partner == size else min(left[size], left[partner])
            place(size, n, bins, 0)
            if partner is None:
                free(capacity - size, bins, n)
            else:
                place(partner, n, bins, size)
                free(capacity - size - partner, bins, n)
            bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            k = bisect_left(open_gaps, size)
            if k < len(open_gaps):
                gap = open_gaps[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[k]
                used = min(n, left[size])
                place(size, used, first, capacity - gap)
                free(gap - size, first, used)
                free(gap, first + used, n - used)
            else:
                each = capacity // size
                n = max(1, left[size] // each)
                held = min(each, left[size])
                for j in range(held):
                    place(size, n, bins, j * size)
                free(capacity - held * size, bins, n)
                bins += n
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def _numbered(rows: DataFrame, per_bucket: int) -> DataFrame:
    """rows with ``number``: from 0 within each length."""
    total = rows.count()
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(max(1, total // per_bucket)))
    marked = rows.withColumn("bucket", bucket)
    sizes = marked.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return marked.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("number", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def _place(runs: np.ndarray):
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = runs[:, 0] << 44 | runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "number"))
            at = runs[np.searchsorted(keys, length << 44 | number, "right") - 1]
            keep = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(at[:, 3] + number - at[:, 1]), pa.array(at[:, 4].copy())], [*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False, per_bucket: int = 8_192) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer_path, capacity, end_id, with_ids), columns)
    cut = persisted(cut, "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    order = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "number"]
    return _numbered(cut, per_bucket).select(*order).mapInArrow(_place(plan_runs(counts, capacity)), columns + ", sequence_id long, offset long")
