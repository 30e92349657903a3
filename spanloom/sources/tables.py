"""The three stored tables: Parquet, partitioned by day, written batch by batch."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.skew import shared_folder, shuffles_dropped
from spanloom.sources import adapter, compaction
from spanloom.sources.compaction import path_exists
from spanloom.sources.summaries import Summaries, write_summaries

# Rows of one kind lie together in a file, so row-group statistics can skip the rest.
CLUSTERING = {
    "logs": ("event_date", "event_name", "timestamp"),
    "points": ("event_date", "metric_name", "timestamp"),
    "spans": ("event_date", "trace_id", "start_timestamp"),
}


def write_telemetry(df: DataFrame, root: str, table: str, batch_id: int, writer: str = "direct") -> str:
    """Write one export batch of a writer, and what it adds to the summaries. Writing it again replaces it; other writers' batches stay."""
    path = f"{root}/{table}/writer={writer}/batch={batch_id}"
    with shuffles_dropped(df.sparkSession):
        (df.hint("rebalance", "event_date").sortWithinPartitions(*CLUSTERING[table])
         .write.mode("overwrite").partitionBy("event_date").parquet(path))
    write_summaries(df.sparkSession.read.schema(df.schema).parquet(path), root, table, batch_id, writer)
    return path


def read_telemetry(spark: SparkSession, root: str, table: str) -> DataFrame:
    return compaction.current(spark, root, table).drop("writer", "batch")


_FIXES = "id bigint, value_delta double, fixed_at timestamp, writer string, batch int, event_date date"


def read_points(spark: SparkSession, root: str) -> DataFrame:
    """Stored points with the newest correction of each increment."""
    return corrected(read_telemetry(spark, root, "points"), root)


def corrected(points: DataFrame, root: str) -> DataFrame:
    """Some stored points with the newest correction of each increment."""
    spark = points.sparkSession
    if not path_exists(spark, f"{root}/point_fixes"):
        return points
    fixes = (compaction.current(spark, root, "point_fixes", _FIXES).groupBy("id", "event_date")
             .agg(F.max_by("value_delta", F.struct("fixed_at", "batch")).alias("fixed")))
    return (points.join(fixes, ["id", "event_date"], "left")
            .withColumn("value_delta", F.coalesce("fixed", "value_delta")).select(*points.columns))


def compact(spark: SparkSession, root: str, table: str, before: date) -> list[str]:
    """Rewrite the days before a date that lie in several folders; returns them.

    Rows delivered again count once from then on, and corrections of points become part of their rows. Ingest may go on
    meanwhile; one compaction of a table runs at a time.
    """
    fixes = table == "points" and path_exists(spark, f"{root}/point_fixes")
    # The corrections are listed before the points are read, so none is folded that was not applied.
    corrected = compaction.closed_days(spark, root, "point_fixes", before, 1) if fixes else {}
    days = compaction.closed_days(spark, root, table, before)
    if not days:
        return []
    rows = read_points(spark, root) if table == "points" else read_telemetry(spark, root, table)
    compaction.commit_snapshot(rows.where(F.col("event_date").isin([date.fromisoformat(d) for d in days])), root, table, days, CLUSTERING[table])
    folded = [place for day, some in corrected.items() if day in days for place in some]
    if folded:
        compaction.commit(spark, root, "point_fixes", compaction.replaced(spark, root, "point_fixes") + folded)
    return sorted(days)


def read_summaries(spark: SparkSession, root: str) -> Summaries:
    """What is kept per session, trace and metric beside the stored tables."""
    fixed = path_exists(spark, f"{root}/session_fixes")
    return Summaries.kept(spark, root, (lambda: read_points(spark, root)) if fixed else None)


@dataclass(frozen=True)
class StoredTelemetry:
    """Tables ingested once per application from a source folder, then only read."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def live(self) -> adapter.Telemetry:
        return adapter.Telemetry(self.spark, self.sf_dir)

    @cached_property
    def root(self) -> str:
        name = hashlib.md5(self.sf_dir.encode()).hexdigest()[:12]
        return f"{shared_folder(self.spark)}/spanloom-{self.spark.sparkContext.applicationId}-{name}"

    def _table(self, name: str) -> DataFrame:
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        write_telemetry(getattr(self.live, name), self.root, name, 0)
        return read_telemetry(self.spark, self.root, name)

    @cached_property
    def logs(self) -> DataFrame:
        return self._table("logs")

    @cached_property
    def points(self) -> DataFrame:
        return self._table("points")

    @cached_property
    def spans(self) -> DataFrame:
        return self._table("spans")

    @cached_property
    def kept(self) -> Summaries:
        for table in ("logs", "points", "spans"):
            getattr(self, table)
        return read_summaries(self.spark, self.root)


_OPEN: dict[tuple[str, str], StoredTelemetry] = {}


def stored(spark: SparkSession, sf_dir: str) -> StoredTelemetry:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = StoredTelemetry(spark, sf_dir)
    return _OPEN[key]
