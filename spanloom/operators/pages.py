"""Rows as a screen shows them: a page of sessions or traces with all that is known of each."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange
from spanloom.functions import expr as E
from spanloom.functions.skew import cut_lineage
from spanloom.operators.sessions import background_active, in_progress_sessions, session_summaries
from spanloom.operators.traces import TraceFilter, in_progress_traces, trace_list
from spanloom.sources.summaries import Summaries

# How long a trace without a root counts as running, and one still logging after its root closed as active.
STALE, BACKGROUND = timedelta(minutes=20), timedelta(minutes=2)
_COUNTS = ("tool_call_count", "denial_count", "user_prompt_count")


def session_page(points: DataFrame, logs: DataFrame, spans: DataFrame, w: TimeRange, now: datetime, sort: str = "cost", descending: bool = True,
                 page: int = 0, size: int = 50, repo: str | None = None, kept: Summaries | None = None) -> DataFrame:
    """A page of ``session_summaries`` with the sessions' counts, first prompt, and whether they are running.

    A session runs while its newest turn is unfinished, or while work that a finished turn dispatched goes on. The
    terminal is ``interactive`` or ``non-interactive``, which also holds where none is known; a start is ``resume`` or ``fresh``.
    """
    kept = kept or Summaries.of(points, spans, logs)
    rows = cut_lineage(session_summaries(points, w, sort, descending, page, size, repo, kept))
    running = in_progress_sessions(logs, spans, now - STALE, rows, kept).unionByName(
        background_active(logs, spans, now - BACKGROUND, rows, kept=kept).select("session_id")).distinct()
    out = (rows.join(kept.session_counts(rows), "session_id", "left").na.fill(0, list(_COUNTS))
           .join(running.withColumn("in_progress", F.lit(True)), "session_id", "left"))
    return out.withColumns({
        "in_progress": F.coalesce("in_progress", F.lit(False)),
        "tokens": F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"),
        "terminal_type": F.when(F.col("terminal_type") == "interactive", "interactive").otherwise("non-interactive"),
        "start_type": F.when(F.col("start_type") == "resume", "resume").otherwise("fresh")})


def background_costs(logs: DataFrame, traces: DataFrame, kept: Summaries, cfg: TelemetryConfig = CFG) -> DataFrame:
    """What some traces were billed after their own interaction root had closed; only later days are read."""
    closed = cut_lineage(kept.traces.join(traces.select("trace_id").distinct(), "trace_id", "left_semi").groupBy("trace_id")
                         .agg(F.max("closed_last").alias("root_end")).where("root_end IS NOT NULL"))
    first_day = closed.agg(F.min(F.date_from_unix_date(F.floor(F.unix_micros("root_end") / F.lit(86_400_000_000)).cast("int")))).scalar()
    late = logs.where((F.col("event_name") == cfg.api_request) & F.col("cost_usd").isNotNull() & (F.col("event_date") >= first_day))
    return (late.select("trace_id", "timestamp", "cost_usd").join(closed, "trace_id").where("timestamp > root_end")
            .groupBy("trace_id").agg(F.sum("cost_usd").cast("double").alias("background_cost_usd")))


def trace_page(spans: DataFrame, logs: DataFrame, now: datetime, sort: str = "new", mode: str = "first", f: TraceFilter = TraceFilter(),
               cursor: tuple | None = None, page: int = 0, size: int = 50, kept: Summaries | None = None) -> DataFrame:
    """A page of ``trace_list`` with each trace's background cost, first prompt, and whether it is running."""
    kept = kept or Summaries.of(spans=spans, logs=logs)
    rows = cut_lineage(trace_list(spans, logs, sort, mode, f, cursor, page, size, kept))
    prompts = (kept.trace_logs.join(rows.select("trace_id"), "trace_id", "left_semi").groupBy("trace_id")
               .agg(E.clean_prompt(F.min("first_prompt")["prompt"]).alias("first_user_prompt")))
    running = in_progress_traces(spans, logs, now - STALE, rows, kept).withColumn("in_progress", F.lit(True))
    out = rows.join(prompts, "trace_id", "left").join(background_costs(logs, rows, kept), "trace_id", "left").join(running, "trace_id", "left")
    return out.withColumns({"in_progress": F.coalesce("in_progress", F.lit(False)), "background_cost_usd": F.coalesce("background_cost_usd", F.lit(0.0))})
