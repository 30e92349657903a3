"""Rewriting closed days of a stored table: few files, no repeats, corrections folded in.

Batches leave a folder per writer, batch and day. A compaction writes the rows of some days anew, as one more writer,
and then commits a manifest that names the folders it replaces. Readers leave those out, so they see a day as it was or
as it is now, never both. Batches that come later, to the same days too, are simply not named and count as before. The
replaced folders stay until ``vacuum``, for readers that began earlier.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.skew import one_of_each, shuffles_dropped

SNAPSHOT = "snapshot-"
_REPLACED = "place string"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def _found(spark: SparkSession, pattern: str) -> list[str]:
    where, files = _files(spark, pattern)
    return sorted(status.getPath().toString() for status in files.globStatus(where) or ())


def places(spark: SparkSession, root: str, table: str) -> list[str]:
    """The ``writer/batch/day`` folders of a table."""
    folders = _found(spark, f"{root}/{table}/writer=*/batch=*/event_date=*")
    return ["/".join(part.partition("=")[2] for part in folder.rsplit("/", 3)[1:]) for folder in folders]


def _version(spark: SparkSession, root: str, table: str) -> int:
    """The newest manifest that was written whole; 0 without any."""
    done = _found(spark, f"{root}/_manifest/{table}/version=*/_SUCCESS")
    return max((int(path.rsplit("/", 2)[1].partition("=")[2]) for path in done), default=0)


def replaced(spark: SparkSession, root: str, table: str) -> list[str]:
    """The folders that readers leave out; as many as wait for ``vacuum``."""
    version = _version(spark, root, table)
    if not version:
        return []
    return [r.place for r in spark.read.schema(_REPLACED).json(f"{root}/_manifest/{table}/version={version}").collect()]


def commit(spark: SparkSession, root: str, table: str, gone: list[str]) -> None:
    """Name all folders that are replaced; readers take the newest manifest that was written whole."""
    version = _version(spark, root, table) + 1
    spark.createDataFrame([(p,) for p in gone], _REPLACED).coalesce(1).write.mode("overwrite").json(f"{root}/_manifest/{table}/version={version}")


def current(spark: SparkSession, root: str, table: str, schema: str | None = None) -> DataFrame:
    """A stored table without what a compaction replaced, with its ``writer`` and ``batch``; the filter prunes folders.

    A snapshot counts from its commit on: one that is being written, or was given up, is left out.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    number = F.regexp_extract("writer", f"^{SNAPSHOT}([0-9]+)$", 1)
    df = reader.parquet(f"{root}/{table}")
    df = df.where((number == "") | (F.coalesce(number.try_cast("int"), F.lit(0)) <= _version(spark, root, table)))
    gone = replaced(spark, root, table)
    return df.where(~lies_in(gone)) if gone else df


def lies_in(folders: list[str]) -> Column:
    """Whether a row lies in one of the ``writer/batch/day`` folders; the filter prunes folders."""
    return F.concat_ws("/", "writer", F.col("batch").cast("string"), F.col("event_date").cast("string")).isin(folders)


def closed_days(spark: SparkSession, root: str, table: str, before: date, least: int = 2) -> dict[str, list[str]]:
    """Days before a date that lie in ``least`` folders or more, with these folders."""
    gone, days, version = set(replaced(spark, root, table)), {}, _version(spark, root, table)
    for place in places(spark, root, table):
        writer, _, day = place.split("/")
        given_up = writer.startswith(SNAPSHOT) and int(writer.removeprefix(SNAPSHOT)) > version
        if place not in gone and not given_up and day < before.isoformat():
            days.setdefault(day, []).append(place)
    return {day: some for day, some in days.items() if len(some) >= least}


def write_snapshot(rows: DataFrame, root: str, table: str, clustering: tuple[str, ...] = ("event_date",)) -> DataFrame:
    """Write rows as the next snapshot, which counts once it replaces folders; returns the rows as written."""
    path = f"{root}/{table}/writer={SNAPSHOT}{_version(rows.sparkSession, root, table) + 1}/batch=0"
    with shuffles_dropped(rows.sparkSession):
        rows.hint("rebalance", "event_date").sortWithinPartitions(*clustering).write.mode("overwrite").partitionBy("event_date").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def replace(spark: SparkSession, root: str, table: str, folders: list[str]) -> None:
    """Have the snapshot that was written last stand for these folders."""
    commit(spark, root, table, replaced(spark, root, table) + folders)


def commit_snapshot(rows: DataFrame, root: str, table: str, days: dict[str, list[str]], clustering: tuple[str, ...]) -> None:
    """Write the rows of some days as a snapshot, and have it replace their folders."""
    write_snapshot(one_of_each(rows), root, table, clustering)
    replace(rows.sparkSession, root, table, [p for some in days.values() for p in some])


def vacuum(spark: SparkSession, root: str, table: str) -> int:
    """Delete the replaced folders and forget them; returns how many there were."""
    gone = replaced(spark, root, table)
    for place in gone:
        writer, batch, day = place.split("/")
        where, files = _files(spark, f"{root}/{table}/writer={writer}/batch={batch}/event_date={day}")
        files.delete(where, True)
    if gone:
        commit(spark, root, table, [])
    return len(gone)
