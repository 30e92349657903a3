"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
import ctypes
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
import xxhash

from spanloom.functions.skew import shared_folder, written

#: Fixed values of the contracts: what separates words, as bytes of UTF-8.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Lower-cases A-Z, and turns separators into blanks; bytes of other characters are left as they are.
ALNUM_TABLE = bytes(0x20 if (low := bytes([b]).lower()[0]) in SEPARATORS else low for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced_words(text: bytes) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(ALNUM_TABLE).split()


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns named, and the whole text as UTF-8 bytes (NULL counts as empty)."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that a result's own columns would clash with, however they are written."""
    wanted = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in wanted])


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo ``modulus``; the folds are made of it."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, seed: str) -> DataFrame:
    """Documents with their labels: all, or those of ``sample`` label rows (doc_id, label) chosen by a hash of the id.

    No more than ``sample`` narrow rows are sent to the tasks, whatever the tables' size.
    """
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id", "label").limit(sample)
    return without(docs, "label").join(F.broadcast(chosen), "doc_id")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files, in the place the cluster shares."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps survive lost executors and reread it cheaply."""
    return written(df, work_folder(df.sparkSession, name))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside; then it is what it was."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_file(path: str, parts: Iterable[bytes]) -> None:
    """Write one file under its final name in one step, so that a repeated attempt only replaces like by like."""
    store, inner = pafs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    attempt = f"{inner}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    store.move(attempt, inner)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker holds on to for the next tasks of the kind, until a task that is ``lean`` runs in it."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def free() -> None:
    """Give this worker's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hand_back() -> None:
    """Drop what tasks before left in this worker, and give its free memory to the system."""
    _KEPT.clear()
    free()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that leaves only what is kept: more workers than run at a time wait for their next tasks."""
    def wrapped(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(stream)
        free()

    return wrapped


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that begins without what other tasks kept and hands its memory back when it ends: workers live on between tasks, beside the next ones."""
    def wrapped(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        yield from run(stream)
        hand_back()

    return wrapped


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before; emptied when it has grown large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value
