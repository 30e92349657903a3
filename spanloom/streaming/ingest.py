"""Continuous ingest of export files, and counter increments kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions.skew import cut_lineage, discard, one_of_each, previous_row, shuffles_dropped
from spanloom.schema import _utc_date, enrich_logs, enrich_points, enrich_spans
from spanloom.sources import compaction
from spanloom.sources.deltas import HEADS, current_value, increment, point_heads
from spanloom.sources.otlp import flatten_otlp_logs, flatten_otlp_metrics, flatten_otlp_spans, rejected_exports
from spanloom.sources.tables import path_exists, read_telemetry, write_telemetry
from spanloom.streaming.stateful import stream_deltas

_SHAPES = {"logs": (flatten_otlp_logs, enrich_logs), "spans": (flatten_otlp_spans, enrich_spans), "points": (flatten_otlp_metrics, enrich_points)}



def _write(df: DataFrame, root: str, name: str, batch_id: int, writer: str) -> None:
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/{name}/writer={writer}/batch={batch_id}")


def merge_points(batch: DataFrame, root: str, batch_id: int, writer: str = "direct") -> None:
    """Append enriched points with their increments; late ones correct their successor.

    Stored files are never rewritten. The predecessor and successor of a new point lie
    either on its own day, whose rows are read for the streams at hand, or at the edge
    of another day, which the small ``point_heads`` table holds per stream and day. A
    successor's new increment goes to ``point_fixes``, which ``read_points`` applies.
    Writing the same batch of a writer again replaces what it wrote before.
    """
    spark = batch.sparkSession
    # Written once: a batch may be costly to derive, as exports are to parse, and every step below reads it.
    derived = cut_lineage(batch.drop("value_delta"))
    batch = one_of_each(derived)
    days = [r.event_date for r in batch.select("event_date").distinct().collect()]
    if not days:
        discard(derived)
        return
    columns = ["stream_id", "event_date", "timestamp", "id", "value", "fresh"]
    others = (F.col("batch") != batch_id) | (F.col("writer") != writer)
    fresh = batch.withColumn("value", current_value()).withColumn("fresh", F.lit(True)).select(*columns, "session_id")
    line = fresh.select(*columns)
    if path_exists(spark, f"{root}/points"):
        stored = compaction.current(spark, root, "points").where(others & F.col("event_date").isin(days))
        fresh = cut_lineage(fresh.join(stored.select("id"), "id", "left_anti"))
        streams = fresh.select("stream_id").distinct()
        same_day = stored.join(streams, "stream_id", "left_semi").withColumn("value", current_value()).withColumn("fresh", F.lit(False))
        heads = compaction.current(spark, root, "point_heads", HEADS).where(others & ~F.col("event_date").isin(days))
        edges = (heads.join(streams, "stream_id", "left_semi").groupBy("stream_id", "event_date")
                 .agg(F.min("first").alias("first"), F.max("last").alias("last")))
        ends = (edges.select("stream_id", "event_date", F.explode(F.array("first", "last")).alias("e"))
                .select("stream_id", "event_date", "e.*", F.lit(False).alias("fresh")).distinct())
        # Rows and chunks of the line are ordered apart; both read it.
        line = cut_lineage(fresh.select(*columns).unionByName(same_day.select(*columns)).unionByName(ends.select(*columns)))
    seen = previous_row(line, ["stream_id"], ["timestamp", "id"], F.struct("value", "fresh"), "before")
    done = cut_lineage(seen.where(F.col("fresh") | F.col("before.fresh"))
                       .withColumn("value_delta", increment(F.col("value"), F.col("before.value"))))
    added = done.where("fresh")
    write_telemetry(batch.join(added.select("id", "value_delta"), "id"), root, "points", batch_id, writer)
    fixes = done.where("NOT fresh").select("id", "event_date", "value_delta", F.current_timestamp().alias("fixed_at"))
    _write(fixes, root, "point_fixes", batch_id, writer)
    # Whose summaries the corrections change: a stream belongs to one session.
    sessions = fresh.where("session_id IS NOT NULL").select("stream_id", "session_id").distinct()
    _write(done.where("NOT fresh").select("stream_id", "event_date").distinct().join(sessions, "stream_id")
           .select("session_id", "event_date").distinct(), root, "session_fixes", batch_id, writer)
    _write(point_heads(added), root, "point_heads", batch_id, writer)
    discard(derived, fresh, line, done)


def _writer(spark: SparkSession, checkpoint: str) -> str:
    """Batch numbers begin anew with each checkpoint, so folders carry the id that the checkpoint was given."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def ingest_exports(spark: SparkSession, source: str, root: str, table: str, checkpoint: str, files_a_batch: int | None = None) -> StreamingQuery:
    """Read new export files as they come and add them to one table; what cannot be read goes to ``rejected``."""
    flatten, enrich = _SHAPES[table]

    def store(requests: DataFrame, batch_id: int) -> None:
        batch = enrich(flatten(requests))
        writer = _writer(batch.sparkSession, checkpoint)
        rejected_exports(requests, table).write.mode("overwrite").parquet(f"{root}/rejected/kind={table}/writer={writer}/batch={batch_id}")
        if table == "points":
            merge_points(batch, root, batch_id, writer)
        else:
            write_telemetry(batch, root, table, batch_id, writer)

    reader = spark.readStream if files_a_batch is None else spark.readStream.option("maxFilesPerTrigger", files_a_batch)
    lines = reader.text(source).withColumn("received_at", F.current_timestamp())
    return (lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def store_increments(changes: DataFrame, root: str, batch_id: int, writer: str) -> None:
    """Upsert increments that a stream of changes brings (``stateful.stream_deltas``); ``read_points`` gives the newest of each point.

    Inserts and updates carry their increment. A ``repair`` row came too late for the stream's state: it is placed among
    the stored points of its stream, and its own increment and its successor's are worked out there. Writing a batch
    again replaces it.
    """
    spark = changes.sparkSession
    changes = cut_lineage(changes)
    stored = read_telemetry(spark, root, "points")
    told = changes.where("change <> 'repair'").select("id", "value_delta", _utc_date(F.timestamp_micros("at")).alias("event_date"))
    late = changes.where("change = 'repair'").select("stream_id", "id")
    line = (stored.join(late.select("stream_id").distinct(), "stream_id", "left_semi")
            .select("stream_id", "event_date", "timestamp", "id", current_value().alias("value")).dropDuplicates(["id"]))
    seen = previous_row(line, ["stream_id"], ["timestamp", "id"], F.struct("value", "id"), "before")
    seen = seen.withColumn("value_delta", increment(F.col("value"), F.col("before.value")))
    placed = seen.join(late.select("id"), "id", "left_semi").unionByName(
        seen.join(late.select(F.col("id").alias("late_id")), F.col("before.id") == F.col("late_id"), "left_semi"))
    # A row both told and placed (its predecessor came late) is right as placed.
    placed = placed.select("id", "value_delta", "event_date").dropDuplicates(["id"])
    fixes = cut_lineage(placed.unionByName(told.join(placed.select("id"), "id", "left_anti")))
    _write(fixes.withColumn("fixed_at", F.current_timestamp()), root, "point_fixes", batch_id, writer)
    sessions = stored.where("session_id IS NOT NULL").select("id", "event_date", "session_id")
    _write(fixes.join(sessions, ["id", "event_date"]).select("session_id", "event_date").distinct(), root, "session_fixes", batch_id, writer)
    discard(changes, fixes)


def stream_increments(spark: SparkSession, root: str, checkpoint: str, lateness_seconds: int = 3600) -> StreamingQuery:
    """Work out the increments of points as they are stored without one, and keep them right as late points come.

    The session's state store must be RocksDB (``stateful.ROCKSDB``).
    """
    points = spark.readStream.schema(spark.read.parquet(f"{root}/points").schema).parquet(f"{root}/points")
    points = points.where(~F.col("writer").startswith(compaction.SNAPSHOT))

    def store(changes: DataFrame, batch_id: int) -> None:
        store_increments(changes, root, batch_id, _writer(changes.sparkSession, checkpoint))

    return (stream_deltas(points, lateness_seconds).writeStream.foreachBatch(store).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
