"""Time bins aligned to the start of the range asked about, not to the epoch."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import TimeRange, micros

# Histogram bin widths in seconds, one minute to two days.
LOG_LADDER = (60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400, 172800)


def pick_bucket_seconds(w: TimeRange, target: int, ladder: Sequence[int] = LOG_LADDER) -> int:
    raw = max(1, int(w.seconds)) // max(1, target)
    return next((step for step in ladder if step >= raw), ladder[-1])


def even_bucket_seconds(w: TimeRange, target: int = 40, minimum: int = 60) -> int:
    return max(minimum, int(w.seconds) // target)


def bin_index(ts: Column | str, origin: datetime, seconds: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    offset = F.unix_micros(ts) - F.lit(micros(origin))
    return F.floor(offset / F.lit(seconds * 1_000_000)).cast("long")


def bin_ts(ts: Column | str, origin: datetime, seconds: int) -> Column:
    return F.timestamp_micros(F.lit(micros(origin)) + bin_index(ts, origin, seconds) * F.lit(seconds * 1_000_000))


def bin_axis(spark: SparkSession, w: TimeRange, seconds: int) -> DataFrame:
    """Every bin of the range, one row each: ``bucket``."""
    last = (micros(w.end) - micros(w.start)) // (seconds * 1_000_000)
    return spark.range(0, last + 1, 1, 1).select(
        F.timestamp_micros(F.lit(micros(w.start)) + F.col("id") * F.lit(seconds * 1_000_000)).alias("bucket"))


def index_axis(spark: SparkSession, bins: int) -> DataFrame:
    return spark.range(0, bins, 1, 1).select(F.col("id").alias("bucket_index"))


def local_time(ts: Column | str, zone: str) -> Column:
    return F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone)
