"""Small tables kept beside the stored ones: a row per batch, day, and session, trace or metric.

Questions about whole lives (a session's cost and bounds, a trace's root and cost, which names exist) read these instead
of all days of the wide tables. Every fact is a sum, a least or a greatest, so rows of several batches merge by grouping,
and a batch that is written again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig
from spanloom.functions import expr as E
from spanloom.functions.skew import shuffles_dropped
from spanloom.sources import compaction

ROOT_PREFIX = "claude_code.interaction"


def first_timestamp() -> Column:
    return F.coalesce("start_timestamp", "timestamp")


def lives(cfg: TelemetryConfig = CFG) -> Column:
    """The points that tell when a session lived."""
    return F.col("metric_name").isin(cfg.cost_metric, cfg.active_metric)


def session_days(points: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Cost, active time and bounds of each session, day and repository."""
    moved = E.moving()

    def total(metric: str) -> Column:
        return F.sum(F.when(moved & (F.col("metric_name") == metric) & F.col("value_double").isNotNull(), F.col("value_delta")))

    return points.where(lives(cfg) & F.col("session_id").isNotNull()).groupBy("session_id", "event_date", "repository_url").agg(
        total(cfg.cost_metric).alias("cost_usd"), total(cfg.active_metric).alias("active_time_seconds"),
        F.min(first_timestamp()).alias("first_any"), F.min(F.when(moved, first_timestamp())).alias("first_moved"),
        F.max(F.when(moved, F.col("timestamp"))).alias("last_moved"))


def metric_days(points: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    return points.groupBy("metric_name", "event_date").agg(F.min("unit").alias("unit"))


def trace_days(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Root candidate, bounds and closing of each trace and day."""
    top = F.col("parent_span_id").isNull()
    interaction = top & F.coalesce(F.col("name").startswith(ROOT_PREFIX), F.lit(False))
    return spans.where(F.col("trace_id").isNotNull()).groupBy("trace_id", "event_date").agg(
        # The parentless span that starts first, else the first span.
        F.min(F.struct((~top).alias("has_parent"), "start_timestamp", "span_id", "name", "session_id")).alias("root"),
        F.max("end_timestamp").alias("latest_end"), F.max(top).alias("has_root"),
        F.max(interaction).alias("has_interaction"), F.min(F.when(interaction, F.col("end_timestamp"))).alias("closed_at"),
        F.max(F.when(interaction, F.col("end_timestamp"))).alias("closed_last"))


def _first_prompt(cfg: TelemetryConfig) -> Column:
    said = (F.col("event_name") == cfg.user_prompt) & E.blank_to_null("prompt").isNotNull()
    return F.min(F.when(said, F.struct("timestamp", "id", "prompt"))).alias("first_prompt")


def trace_log_days(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Cost and first prompt of each trace and day."""
    priced = (F.col("event_name") == cfg.api_request) & F.col("cost_usd").isNotNull()
    rows = logs.where((priced | (F.col("event_name") == cfg.user_prompt)) & F.col("trace_id").isNotNull())
    return rows.groupBy("trace_id", "event_date").agg(F.sum(F.when(priced, F.col("cost_usd"))).alias("cost_usd"), _first_prompt(cfg))


def session_log_days(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Calls, denials and prompts of each session and day, with its first and latest prompt."""
    event = F.col("event_name")
    rows = logs.where(event.isin(cfg.tool_result, cfg.tool_decision, cfg.user_prompt) & F.col("session_id").isNotNull())
    return rows.groupBy("session_id", "event_date").agg(
        F.count_if(event == cfg.tool_result).alias("tool_call_count"),
        F.count_if((event == cfg.tool_decision) & (F.col("decision") == "reject")).alias("denial_count"),
        F.count_if(event == cfg.user_prompt).alias("user_prompt_count"), _first_prompt(cfg),
        F.max(F.when(event == cfg.user_prompt, F.struct("timestamp", "id", "trace_id"))).alias("latest"))


_OF: dict[str, dict[str, Callable[..., DataFrame]]] = {
    "points": {"session_days": session_days, "metric_days": metric_days},
    "spans": {"trace_days": trace_days},
    "logs": {"trace_log_days": trace_log_days, "session_log_days": session_log_days},
}


def write_summaries(batch: DataFrame, root: str, table: str, batch_id: int, writer: str) -> None:
    """Write what a stored batch adds to the summaries."""
    for name, rows in summaries_of(batch, table).items():
        with shuffles_dropped(rows.sparkSession):
            rows.write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/{name}/writer={writer}/batch={batch_id}")


def summaries_of(rows: DataFrame, table: str) -> dict[str, DataFrame]:
    """What rows of a stored table add to each of its summaries."""
    return {name: summarise(rows) for name, summarise in _OF[table].items()}


@dataclass(frozen=True)
class Summaries:
    """The summaries: as kept beside stored tables, or worked out from tables at hand."""

    frame: Callable[[str], DataFrame]

    @classmethod
    def of(cls, points: DataFrame | None = None, spans: DataFrame | None = None, logs: DataFrame | None = None, cfg: TelemetryConfig = CFG) -> "Summaries":
        tables = {"points": points, "spans": spans, "logs": logs}
        ways = {name: (summarise, table) for table, some in _OF.items() for name, summarise in some.items()}

        def frame(name: str) -> DataFrame:
            summarise, table = ways[name]
            return summarise(tables[table], cfg)

        return cls(frame)

    @classmethod
    def kept(cls, spark: SparkSession, root: str, corrected: Callable[[], DataFrame] | None = None) -> "Summaries":
        """Read from ``root``. ``corrected`` gives the points with late corrections; without any it is not needed.

        A correction changes sums that were kept, so the few sessions and days named in ``session_fixes`` are worked
        out from their points again.
        """
        def frame(name: str) -> DataFrame:
            df = compaction.current(spark, root, name).drop("writer", "batch")
            if name != "session_days" or corrected is None:
                return df
            fixed = spark.read.parquet(f"{root}/session_fixes").select("session_id", "event_date").distinct()
            again = session_days(corrected().join(fixed, ["session_id", "event_date"], "left_semi"))
            return df.join(fixed, ["session_id", "event_date"], "left_anti").unionByName(again.select(*df.columns))

        return cls(frame)

    @cached_property
    def sessions(self) -> DataFrame:
        return self.frame("session_days")

    @cached_property
    def metrics(self) -> DataFrame:
        return self.frame("metric_days")

    @cached_property
    def traces(self) -> DataFrame:
        return self.frame("trace_days")

    @cached_property
    def trace_logs(self) -> DataFrame:
        return self.frame("trace_log_days")

    @cached_property
    def session_logs(self) -> DataFrame:
        return self.frame("session_log_days")

    def session_lives(self, repo: str | None = None, sessions: DataFrame | None = None) -> DataFrame:
        """One row per session: whole-life cost, active time and bounds; of some sessions, or all."""
        rows = self.sessions.where(E.in_repository(repo))
        if sessions is not None:
            rows = rows.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
        return rows.groupBy("session_id").agg(
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum("active_time_seconds"), F.lit(0.0)).alias("active_time_seconds"),
            F.min("first_any").alias("first_any"), F.min("first_moved").alias("first_moved"), F.max("last_moved").alias("last_moved"))

    def session_counts(self, sessions: DataFrame) -> DataFrame:
        """Calls, denials, prompts and the first prompt of some sessions, over their whole lives."""
        rows = self.session_logs.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
        counts = ("tool_call_count", "denial_count", "user_prompt_count")
        return rows.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in counts], E.clean_prompt(F.min("first_prompt")["prompt"]).alias("first_user_prompt"))
