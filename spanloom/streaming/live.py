"""Live views over the log stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import micros
from spanloom.operators.log_explorer import SEVERITIES, LogFilter, _beside


def live_histogram(logs: DataFrame, f: LogFilter, bucket_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Counts by severity per bin of a log stream, bins aligned to the range's start."""
    offset = micros(f.w.start) % (bucket_seconds * 1_000_000)
    bins = F.window("timestamp", f"{bucket_seconds} seconds", startTime=f"{offset} microseconds")
    return (logs.where(f.test("severity")).withWatermark("timestamp", delay).groupBy(bins.alias("w"))
            .agg(*[F.count_if(F.col("derived_severity") == s).alias(f"{s.lower()}_count") for s in SEVERITIES])
            .select(F.col("w.start").alias("bucket"), *[f"{s.lower()}_count" for s in SEVERITIES]))


def live_tail(logs: DataFrame, f: LogFilter, cursor: tuple[datetime, int]) -> DataFrame:
    """Rows of a log stream past a cursor."""
    return logs.where(f.test() & _beside(*cursor, before=False))
