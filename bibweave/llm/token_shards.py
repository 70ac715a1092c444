"""Token-id shards: raw id payloads with a minimal perfect hash index from document keys to offsets.

File format (little-endian, one shard per file, followed by one line feed that Spark's text writer adds):

    8 bytes  magic ``BWIDS001``
    7 x i64  range partition, number in it, rows, distinct keys, ids, bytes per id (2 or 4), hash buckets
    i64      offset of each row's first id, and the end           (rows + 1)
    i64      key of each row, 0 where null                        (rows)
    u8       1 where the key is null                              (rows)
    i32      displacement of each bucket                          (buckets)
    u32      fingerprint of the key at each slot                  (distinct keys)
    u32      row of the key at each slot                          (distinct keys)
    ids      the payload

A key is found by directory -> shard -> hash -> bucket -> displacement -> slot -> fingerprint -> row -> offset: the directory (a
Parquet table of key ranges, ``write_directory``) names the shard, inside it the way is of constant length. Rows are in
ascending key order over all shards (nulls first; rows that repeat a key follow each other and the index names the first).

Spark sorts by range; each task cuts its range into shards of about ``shard_ids`` ids, so a task holds one shard at a time.
Files are written by Spark's text writer from binary rows and read by its binaryFile reader: any store Spark reaches will do,
and a lost task is simply run again.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bibweave.llm.bpe import encoder
from bibweave.llm.wordbytes import mixed
from bibweave.llm.wordbytes import pieces as slices
from bibweave.session import persisted, scratch_root

MAGIC = b"BWIDS001"
STEP = np.uint64(0x9E3779B97F4A7C15)
PRINT = np.uint64(0xC2B2AE3D27D4EB4F)


class PerfectHash:
    """Hash and displace: keys fall into buckets of about four, the largest buckets first search a displacement that puts all
    their keys on free slots; buckets of one take a slot that is left."""

    def __init__(self, n: int, displacement: np.ndarray):
        self.n, self.displacement = n, displacement

    @staticmethod
    def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        return (mixed(h + d * STEP) % np.uint64(n)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        h = mixed(keys.view(np.uint64))
        buckets = max(1, (n + 3) // 4)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        displacement = np.zeros(buckets, dtype=np.int32)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        ends = np.cumsum(sizes)
        used = np.zeros(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if size < 2:
                break
            own, d = h[order[ends[b] - size : ends[b]]], 0
            while True:
                tries = np.arange(d, d + 16, dtype=np.uint64)
                at = cls._slots(own[None, :], tries[:, None], n)
                near = np.sort(at, axis=1)
                good = ~used[at].any(axis=1) & (near[:, 1:] != near[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    displacement[b] = d + k
                    used[at[k]] = True
                    break
                d += 16
        alone = np.flatnonzero(sizes == 1)
        displacement[alone] = -np.flatnonzero(~used)[: len(alone)] - 1
        return cls(n, displacement)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = mixed(keys.view(np.uint64))
        d = self.displacement[(h % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        return np.where(d < 0, -d - 1, self._slots(h, np.maximum(d, 0).astype(np.uint64), self.n))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(mixed(keys.view(np.uint64)) ^ PRINT) >> np.uint64(32)).astype(np.uint32)


def write_shard(part: int, number: int, keys: list[int | None], ids: np.ndarray, offsets: np.ndarray, id_bytes: int) -> bytes:
    null = np.array([k is None for k in keys], dtype=np.uint8)
    key = np.array([k or 0 for k in keys], dtype=np.int64)
    named = np.flatnonzero(null == 0)
    distinct, first = np.unique(key[named], return_index=True)
    index = PerfectHash.of(distinct)
    prints, rows = np.zeros(len(distinct), dtype=np.uint32), np.zeros(len(distinct), dtype=np.uint32)
    if len(distinct):
        at = index.slots(distinct)
        prints[at], rows[at] = fingerprints(distinct), named[first]
    head = np.array([part, number, len(keys), len(distinct), len(ids), id_bytes, len(index.displacement)], dtype="<i8")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, offsets.astype("<i8"), key, null, index.displacement, prints, rows, ids.astype(f"<u{id_bytes}")))])


class Shard:
    """A shard that was read; arrays are views of its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.part, self.number, self.rows, self.n_keys, self.n_ids, size, buckets = np.frombuffer(data, "<i8", 7, 8).tolist()
        at = 64
        arrays = []
        for kind, n in (("<i8", self.rows + 1), ("<i8", self.rows), ("u1", self.rows), ("<i4", buckets), ("<u4", self.n_keys), ("<u4", self.n_keys), (f"<u{size}", self.n_ids)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        self.offsets, self.keys, self.null, displacement, self.prints, self.row_at, self.ids = arrays
        self.index = PerfectHash(self.n_keys, displacement)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 where the shard's fingerprint or key says it has none."""
        if not self.n_keys or not len(keys):
            return np.full(len(keys), -1)
        slot = self.index.slots(keys)
        row = self.row_at[slot].astype(np.int64)
        return np.where((self.prints[slot] == fingerprints(keys)) & (self.keys[row] == keys), row, -1)

    def ids_of(self, row: int) -> np.ndarray:
        return self.ids[self.offsets[row] : self.offsets[row + 1]]


def _build(path: str, end_id: int, shard_ids: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(path), TaskContext.get().partitionId(), 0
        keys, parts, sizes = [], [], []

        def shard() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            data = write_shard(part, number, keys, np.concatenate(parts), offsets, id_bytes)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for batch in batches:
            for piece in slices(batch, "text"):
                flat, at = enc.encode(piece.column(1))
                out = np.insert(flat, at[1:], np.uint32(end_id))
                if len(out) and int(out.max()) >> (8 * id_bytes):
                    raise ValueError(f"id {int(out.max())} does not fit in {id_bytes} bytes")
                keys += piece.column(0).to_pylist()
                parts.append(out)
                sizes += (np.diff(at) + 1).tolist()
                if sum(map(len, parts)) >= shard_ids:
                    yield shard()
                    keys, parts, sizes, number = [], [], [], number + 1
        if keys:
            yield shard()

    return run


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes that hold every id of the tokenizer: 2 or 4."""
    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = 1 << 21, id_bytes: int | None = None) -> None:
    """Writes the shards of docs under path. A null text is its end id alone; an empty table writes no shard. Ids take the bytes
    that the tokenizer's vocabulary needs; one that doesn't fit raises. Keys are 64-bit integers.

    The text writer copies the bytes of a string as they are, and a cast from binary to string keeps them; a reader that finds
    other bytes than the magic raises.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))
    blobs = ordered.mapInArrow(_build(tokenizer_path, end_id, shard_ids, id_bytes or id_width(tokenizer_path, end_id)), "data binary")
    blobs.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0").select("content")  # partitions without rows write empty files


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            s = Shard(memoryview(data.as_buffer()).tobytes())
            row = np.arange(s.rows)
            named = np.flatnonzero(s.null == 0)
            first = s.find(s.keys[named])  # by the index; a repeated key's later rows follow its first
            repeat = np.zeros(len(named), dtype=np.int64)
            if len(named):
                fresh = np.append(True, s.keys[named][1:] != s.keys[named][:-1])
                repeat = np.arange(len(named)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            row[named] = first + repeat
            crc = [zlib.crc32(s.ids_of(int(r)).astype("<u4").tobytes()) for r in row]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.part] * s.rows, pa.int64()), pa.array([s.number] * s.rows, pa.int64()), pa.array(s.keys, mask=s.null.astype(bool)), pa.array(s.offsets[row]), pa.array(s.offsets[row + 1] - s.offsets[row]), pa.array(crc, pa.int64())],
                ["part", "number", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, found through the shards' indexes: doc_id, start, n_tokens, ids_crc32."""
    rows = persisted(read_blobs(spark, path).mapInArrow(_rows_of, "part long, number long, doc_id long, offset long, n_tokens long, ids_crc32 long"), "rows")
    shards = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    inside = shards.select("part", "number", (F.sum("ids").over(Window.partitionBy("part").orderBy("number")) - F.col("ids")).alias("inside"))
    parts = shards.groupBy("part").agg(F.sum("ids").alias("ids"))  # one row per range partition
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return rows.join(inside, ["part", "number"]).join(before, "part").select("doc_id", (F.col("offset") + F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _key_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [Shard(data.as_py()) for data in batch.column(1)]
        named = [s.keys[s.null == 0] for s in heads]
        low, high = (pa.array([int(k[i]) if len(k) else None for k in named], pa.int64()) for i in (0, -1))
        yield pa.RecordBatch.from_arrays([batch.column(0), low, high], ["file", "low", "high"])


def write_directory(spark: SparkSession, path: str, directory: str) -> None:
    """The key range of each shard (file, low, high) as a small Parquet table: one pass over the shards."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0").select("path", "content")
    files.mapInArrow(_key_range, "file string, low long, high long").where("low IS NOT NULL").write.parquet(directory)


def fetch(spark: SparkSession, directory: str, keys: list[int]) -> DataFrame:
    """Keyed access: doc_id, ids of the given keys (a list the caller holds), every row of a key that repeats. Only the shards whose
    range holds a key are opened; in them a key is found in constant time."""
    wanted = np.array(sorted(set(keys)), dtype=np.int64)
    asked = F.broadcast(spark.createDataFrame([(int(k),) for k in wanted], "key long"))
    ranges = spark.read.parquet(directory)
    files = [r.file for r in ranges.join(asked, F.col("key").between(F.col("low"), F.col("high")), "left_semi").select("file").collect()]  # as many as keys, but for ones that repeat over shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = Shard(data.as_py())
                found, ids = [], []
                for key, row in zip(wanted.tolist(), s.find(wanted).tolist(), strict=True):
                    while 0 <= row < s.rows and s.keys[row] == key and not s.null[row]:
                        found.append(key)
                        ids.append(s.ids_of(row).astype(np.int64))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    schema = "doc_id long, ids array<long>"
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, schema) if files else spark.createDataFrame([], schema)


def round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Writes docs as shards (under the shared scratch folder where path is None) and reads their index back."""
    path = path or os.path.join(scratch_root(docs.sparkSession), "bibweave", uuid.uuid4().hex, "shards")
    write_shards(docs, path, tokenizer_path, **options)
    return read_index(docs.sparkSession, path)
