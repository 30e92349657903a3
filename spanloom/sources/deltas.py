"""Reset-aware increments of cumulative counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.expr import moving
from spanloom.functions.skew import previous_row


def current_value() -> Column:
    return F.coalesce(F.col("value_long").cast("double"), F.col("value_double"), F.lit(0.0))


def increment(current: Column, previous: Column) -> Column:
    """Growth since the previous point; a fall means the counter restarted."""
    previous = F.coalesce(previous, F.lit(0.0))
    return F.when(current >= previous, current - previous).otherwise(current)


def counter_deltas(points: DataFrame) -> DataFrame:
    with_previous = previous_row(points, ["stream_id"], ["timestamp", "id"], current_value(), "__previous")
    return (with_previous.withColumn("value_delta", increment(current_value(), F.col("__previous")))
            .drop("__previous"))


def repair_deltas(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows whose increment is new or changed once ``batch`` joins ``existing``.

    Only the streams of the batch are read again. The answer holds the batch rows
    and every stored row whose increment a late row changed.
    """
    touched = batch.select("stream_id").distinct()
    stored = existing.join(touched, "stream_id", "left_semi")
    fresh = batch.drop("value_delta").withColumn("__stored", F.lit(None).cast("double")).withColumn("__new", F.lit(True))
    old = stored.withColumnRenamed("value_delta", "__stored").withColumn("__new", F.lit(False))
    redone = counter_deltas(old.unionByName(fresh))
    changed = F.col("__new") | ~F.col("__stored").eqNullSafe(F.col("value_delta"))
    return redone.where(changed).drop("__stored", "__new")


def apply_repairs(existing: DataFrame, repairs: DataFrame) -> DataFrame:
    """Existing rows with the repaired ones in their place, new ones added."""
    kept = existing.join(repairs.select("id"), "id", "left_anti")
    return kept.unionByName(repairs.select(*kept.columns))


def points_moving(points: DataFrame) -> DataFrame:
    """The small share of points that changed their counter; most sums need only these."""
    return points.where(moving())


def newest_per_stream(points: DataFrame) -> DataFrame:
    newest = points.groupBy("stream_id").agg(F.max(F.struct("timestamp", "id")).alias("newest"))
    return newest.select("stream_id", F.col("newest.id").alias("id"))


__all__ = ["counter_deltas", "repair_deltas", "apply_repairs", "points_moving", "newest_per_stream"]


#: The stored heads: a row per stream, day and batch.
_POINT_OF = "struct<timestamp: timestamp, id: bigint, value: double>"
HEADS = f"stream_id string, first {_POINT_OF}, last {_POINT_OF}, writer string, batch int, event_date date"


def point_heads(points: DataFrame) -> DataFrame:
    """First and last point of each stream and day; rows need ``value``."""
    edge = F.struct("timestamp", "id", "value")
    return points.groupBy("stream_id", "event_date").agg(F.min(edge).alias("first"), F.max(edge).alias("last"))
