"""Exact duplicates by an extendible-hash index on shared files."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
import xxhash
import zstandard

from spanloom.llm.common import LOWER, UPPER, batches, read_table, texts, work_folder, write_file

#: Bytes of text an owner task takes, and distinct keys a bucket holds before it is split.
OWNER_BYTES, BUCKET_KEYS = 16 << 20, 64
_HEADER = struct.Struct("<4sIQQ")
_ENTRY = np.dtype([("bucket", "<u4"), ("key", "<u8"), ("sha", "V32"), ("keep", "<i8"), ("known", "u1"), ("size", "<i8"),
                   ("start", "<u8"), ("length", "<u8")])


class ExtendibleIndex:
    """A directory of buckets, doubled as buckets overflow. Keys are 64-bit hashes; unequal texts of one key are chained."""

    def __init__(self, capacity: int = BUCKET_KEYS):
        self.capacity, self.depth = capacity, 0
        self.directory: list[int] = [0]
        self.depths: list[int] = [0]
        self.buckets: list[dict[int, list[list]]] = [{}]

    def add(self, key: int, text: bytes, doc_id: int | None, size: int) -> None:
        """Count ``size`` documents of this text; the bytes decide which entry of the chain is theirs."""
        chain = self.buckets[self.directory[key & ((1 << self.depth) - 1)]].setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                entry[1] = doc_id if entry[1] is None else entry[1] if doc_id is None else max(entry[1], doc_id)
                entry[2] += size
                return
        chain.append([text, doc_id, size])
        while len(self.buckets[at := self.directory[key & ((1 << self.depth) - 1)]]) > self.capacity:
            self._split(at)

    def _split(self, at: int) -> None:
        local = self.depths[at]
        if local == self.depth:
            self.directory += self.directory
            self.depth += 1
        held, new = self.buckets[at], len(self.buckets)
        self.buckets.append({k: v for k, v in held.items() if k >> local & 1})
        self.buckets[at] = {k: v for k, v in held.items() if not k >> local & 1}
        self.depths[at] = local + 1
        self.depths.append(local + 1)
        step = 1 << (local + 1)
        first = next(i for i, b in enumerate(self.directory) if b == at) % (1 << local)
        for slot in range(first + (1 << local), len(self.directory), step):
            self.directory[slot] = new

    def find(self, key: int, text: bytes) -> list | None:
        for entry in self.buckets[self.directory[key & ((1 << self.depth) - 1)]].get(key, ()):
            if entry[0] == text:
                return entry
        return None

    def dump(self) -> tuple[list[bytes], list[bytes]]:
        """The index file (directory, then entries by bucket) and the file of texts it points into."""
        rows, blobs, at = [], [], 0
        packer = zstandard.ZstdCompressor(level=1)
        for b, bucket in enumerate(self.buckets):
            for key, chain in bucket.items():
                for text, keep, size in chain:
                    blob = packer.compress(text)
                    rows.append((b, key, hashlib.sha256(text).digest(), keep or 0, keep is not None, size, at, len(blob)))
                    blobs.append(blob)
                    at += len(blob)
        head = _HEADER.pack(b"XHI1", self.depth, len(self.directory), len(rows))
        return [head, np.array(self.directory, dtype="<u4").tobytes(), np.array(rows, dtype=_ENTRY).tobytes()], blobs


def read_entries(content: bytes) -> np.ndarray:
    _, _, slots, n = _HEADER.unpack_from(content)
    return np.frombuffer(content, dtype=_ENTRY, count=n, offset=_HEADER.size + 4 * slots)


def look_up(index: bytes, data: bytes, text: bytes) -> tuple[int | None, int] | None:
    """(row that stays, group size) of a text in one owner's files, by directory, bucket, key and bytes."""
    text = text.lower()
    _, depth, slots, _ = _HEADER.unpack_from(index)
    key = xxhash.xxh3_64_intdigest(text)
    bucket = np.frombuffer(index, dtype="<u4", count=slots, offset=_HEADER.size)[key & ((1 << depth) - 1)]
    entries = read_entries(index)
    low, high = np.searchsorted(entries["bucket"], [bucket, bucket + 1])
    for e in entries[low:high][entries["key"][low:high] == key]:
        if zstandard.ZstdDecompressor().decompress(data[int(e["start"]):int(e["start"]) + int(e["length"])], max_output_size=max(1, len(text))) == text:
            return (int(e["keep"]) if e["known"] else None), int(e["size"])
    return None


def build_index(docs: DataFrame, folder: str, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """Write the index of all texts to ``folder``: one pair of files per owner of a range of keys.

    Equal texts of a batch become one row before the shuffle, so a text that a third of all rows share reaches its
    owner once per batch. Returns (owner, entries); it must be run for the files to exist.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(1, -(-int(total) // owner_bytes))
    partial = pa.schema([("owner", pa.int64()), ("key", pa.int64()), ("text", pa.binary()), ("doc_id", pa.int64()), ("size", pa.int64())])

    def combine(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            seen: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entry = seen.setdefault(text.lower(), [None, 0])
                entry[0] = doc_id if entry[0] is None else entry[0] if doc_id is None else max(entry[0], doc_id)
                entry[1] += 1
            keys = ((xxhash.xxh3_64_intdigest(t), t, e) for t, e in seen.items())
            yield from batches(((k * owners >> 64, k - (1 << 63), t, *e) for k, t, e in keys), partial, 1024)

    def own(table: pa.Table) -> pa.Table:
        index, owner = ExtendibleIndex(), table.column("owner")[0].as_py()
        for key, text, doc_id, size in zip(*(table.column(c).to_pylist() for c in ("key", "text", "doc_id", "size"))):
            index.add(key + (1 << 63), text, doc_id, size)
        head, blobs = index.dump()
        write_file(f"{folder}/owner-{owner:08d}.dat", blobs)
        write_file(f"{folder}/owner-{owner:08d}.idx", head)
        return pa.table({"owner": pa.array([owner], pa.int64()), "entries": pa.array([sum(map(len, (c for b in index.buckets for c in b.values())))], pa.int64())})

    rows = texts(docs, "doc_id").mapInArrow(combine, "owner long, key long, text binary, doc_id long, size long")
    return rows.groupBy("owner").applyInArrow(own, "owner long, entries long")


def index_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(text_sha256, keep_id, group_size) of every text in the index files."""
    schema = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def parse(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for content in batch.column(0):
                entries = read_entries(content.as_buffer().to_pybytes())
                yield from batches(((bytes(e["sha"]).hex(), int(e["keep"]) if e["known"] else None, int(e["size"])) for e in entries), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder).select("content")
    return files.mapInArrow(parse, "text_sha256 string, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, folder: str | None = None, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """Which row of each group of equal texts stays: (doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    Texts are equal when identical after lower-casing A-Z. The largest doc_id stays. NULL and empty texts are equal.
    A NULL doc_id stays only where its whole group has none. Rows repeated with their doc_id are one document: all of
    them are kept. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    folder = folder or work_folder(spark, "exact-index")
    build_index(docs, folder, owner_bytes).write.mode("overwrite").parquet(f"{folder}/owners")
    text = F.coalesce(F.translate("text", UPPER, LOWER), F.lit(""))
    rows = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"))
    found = rows.join(index_entries(spark, folder), "text_sha256", "left")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""
