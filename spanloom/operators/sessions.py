"""Sessions: summaries, counts, KPIs, activity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange, ts_lit
from spanloom.functions import expr as E
from spanloom.functions.skew import cut_lineage, first_rows, percentiles_of
from spanloom.functions.timebins import bin_index, index_axis
from spanloom.sources.summaries import ROOT_PREFIX, Summaries, first_timestamp, lives

BACKGROUND_GRACE_SECONDS = 5.0
NEW_SESSION_BINS = 24
_TOKEN_COLUMNS = dict(input_tokens="input", output_tokens="output", cache_creation_tokens="cacheCreation", cache_read_tokens="cacheRead")


def _is(metric: str) -> Column:
    return F.col("metric_name") == metric


def _delta(test: Column) -> Column:
    return F.sum(F.when(test, F.col("value_delta")))


def _token_columns(test: Column) -> list[Column]:
    return [F.coalesce(E.rounded_long(_delta(test & (F.col("token_type") == kind))), F.lit(0)).alias(name)
            for name, kind in _TOKEN_COLUMNS.items()]


def _sort_value(key: str) -> Column:
    c = F.col
    tokens = c("input_tokens") + c("output_tokens") + c("cache_creation_tokens") + c("cache_read_tokens")
    return {
        "cost": c("cost_usd"), "active": c("active_time_seconds"), "wall": c("wall_seconds"), "tokens": tokens,
        "cacheEfficiency": E.cache_efficiency("input_tokens", "cache_creation_tokens", "cache_read_tokens"),
        "costPerMinute": F.when(c("active_time_seconds") > 0, c("cost_usd") / c("active_time_seconds") * 60),
        "started": c("first_seen"), "ended": c("last_seen"),
    }[key]


def session_facts(points: DataFrame, w: TimeRange, repo: str | None = None, kept: Summaries | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    """One row per session whose cost or active time moved in the range.

    The points of the range tell which sessions moved, their windowed tokens and earliest windowed start; whole-life
    cost, activity and bounds come from the summaries of these sessions.
    """
    moved = E.moving()
    rows = points.where(F.col("session_id").isNotNull() & w.scan() & E.in_repository(repo)
                        & (((lives(cfg) | _is(cfg.token_metric)) & moved) | _is(cfg.session_metric)))
    start = F.struct(F.col("attributes")["start_type"].alias("start_type"),
                     F.col("attributes")["terminal.type"].alias("terminal_type"))
    inside = rows.groupBy("session_id").agg(
        F.count_if(lives(cfg)).alias("__moved"), *_token_columns(_is(cfg.token_metric)),
        F.min_by(start, F.when(_is(cfg.session_metric), F.struct(first_timestamp().alias("t"), F.col("id")))).alias("__start")).where("__moved > 0")
    # Read twice below: for its sessions and for its figures.
    inside = cut_lineage(inside)
    whole = (kept or Summaries.of(points=points, cfg=cfg)).session_lives(repo, inside)
    whole = whole.select("session_id", "cost_usd", "active_time_seconds", F.col("first_moved").alias("first_seen"), F.col("last_moved").alias("last_seen"))
    return (whole.join(inside, "session_id")
            .withColumn("wall_seconds", F.floor((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6 + 0.5).cast("long"))
            .withColumn("start_type", F.col("__start.start_type")).withColumn("terminal_type", F.col("__start.terminal_type"))
            .drop("__moved", "__start"))


def session_summaries(points: DataFrame, w: TimeRange, sort: str = "cost", descending: bool = True, page: int = 0,
                      size: int = 50, repo: str | None = None, kept: Summaries | None = None) -> DataFrame:
    facts = session_facts(points, w, repo, kept)
    key = _sort_value(sort)
    order = F.desc_nulls_last(key) if descending else F.asc_nulls_last(key)
    total = facts.agg(E.row_count()).scalar()
    return facts.orderBy(order, "session_id").offset(page * size).limit(size).withColumn("total_count", total)


def _only(df: DataFrame, ids: DataFrame | None, column: str = "session_id") -> DataFrame:
    return df if ids is None else df.join(ids.select(column).distinct(), column, "left_semi")


def session_counts(logs: DataFrame, ids: DataFrame | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    event = F.col("event_name")
    prompted = (event == cfg.user_prompt) & E.blank_to_null("prompt").isNotNull()
    return _only(logs.where(F.col("session_id").isNotNull()), ids).groupBy("session_id").agg(
        F.count_if(event == cfg.tool_result).alias("tool_call_count"),
        F.count_if((event == cfg.tool_decision) & (F.col("decision") == "reject")).alias("denial_count"),
        F.count_if(event == cfg.user_prompt).alias("user_prompt_count"),
        F.min_by(E.clean_prompt("prompt"), F.when(prompted, F.struct("timestamp", "id"))).alias("first_user_prompt"))


def first_prompts(logs: DataFrame, ids: DataFrame | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.user_prompt) & E.blank_to_null("prompt").isNotNull()
                      & F.col("session_id").isNotNull())
    return _only(rows, ids).groupBy("session_id").agg(
        F.min_by(E.clean_prompt("prompt"), F.struct("timestamp", "id")).alias("first_user_prompt"))


def session_kpis(points: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    with_value = F.col("value_double").isNotNull()
    per = (points.where(lives(cfg) & F.col("session_id").isNotNull() & E.moving() & w.scan() & E.in_repository(repo))
           .groupBy("session_id").agg(
               F.coalesce(_delta(_is(cfg.cost_metric) & with_value), F.lit(0.0)).alias("cost"),
               F.coalesce(_delta(_is(cfg.active_metric) & with_value), F.lit(0.0)).alias("active")))
    cost, rate = F.col("cost"), F.when(F.col("active") > 0, F.col("cost") / F.col("active") * 60)
    found = percentiles_of(per, [], {"median_cost_usd": (cost, 0.5), "p95_cost_usd": (cost, 0.95),
                                     "median_cost_per_active_minute_usd": (rate, 0.5)})
    return found.na.fill(0.0).withColumn("total_sessions", per.agg(E.row_count()).scalar())


def new_sessions_trend(points: DataFrame, w: TimeRange, bins: int = NEW_SESSION_BINS, repo: str | None = None,
                       kept: Summaries | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Sessions by the bin of their very first point, of those that moved in the range."""
    seconds = max(1, int(w.seconds) // bins)
    moved = points.where(lives(cfg) & F.col("session_id").isNotNull() & E.moving() & w.scan() & E.in_repository(repo)).select("session_id")
    first = (kept or Summaries.of(points=points, cfg=cfg)).session_lives(repo, moved).where(w.contains("first_any"))
    counts = (first.groupBy(F.least(bin_index("first_any", w.start, seconds), F.lit(bins - 1)).alias("bucket_index"))
              .agg(E.row_count().alias("new_sessions")))
    return index_axis(points.sparkSession, bins).join(counts, "bucket_index", "left").na.fill(0).orderBy("bucket_index")


def worst_cache_sessions(points: DataFrame, w: TimeRange, min_tokens: int | None = None, n: int | None = 8,
                         repo: str | None = None, kept: Summaries | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    min_tokens = cfg.min_cache_input_tokens if min_tokens is None else min_tokens
    rows = points.where(F.col("session_id").isNotNull() & w.scan() & E.in_repository(repo)
                        & (lives(cfg) | (_is(cfg.token_metric) & E.moving())))
    per = rows.groupBy("session_id").agg(
        F.count_if(lives(cfg)).alias("__seen"), F.count_if(_is(cfg.token_metric)).alias("__tokens"), *_token_columns(_is(cfg.token_metric)))
    side = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    per = cut_lineage(per.where("__seen > 0 AND __tokens > 0").drop("__seen", "__tokens")
                      .withColumn("input_side_tokens", side).where(F.col("input_side_tokens") >= min_tokens))
    whole = (kept or Summaries.of(points=points, cfg=cfg)).session_lives(repo, per).select("session_id", "cost_usd", F.col("last_moved").alias("last_seen"))
    ordered = (per.join(whole, "session_id")
               .withColumn("cache_efficiency", E.cache_efficiency("input_tokens", "cache_creation_tokens", "cache_read_tokens"))
               .withColumn("band", E.cache_band("cache_efficiency"))
               .orderBy("cache_efficiency", F.desc("input_side_tokens"), "session_id"))
    return first_rows(ordered, n)


# Activity.

def root_spans(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("parent_span_id").isNull() & F.col("name").startswith(ROOT_PREFIX))


def trace_activity(spans: DataFrame, logs: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Latest span end or log time per trace."""
    ends = _only(spans.select("trace_id", F.col("end_timestamp").alias("at")), traces, "trace_id")
    seen = _only(logs.select("trace_id", F.col("timestamp").alias("at")), traces, "trace_id")
    return ends.unionByName(seen).groupBy("trace_id").agg(F.max("at").alias("last_activity"))


def active_traces(kept: Summaries, logs: DataFrame, since: datetime, traces: DataFrame) -> DataFrame:
    """Which of some traces had a span end or a log after ``since``."""
    ended = kept.traces.where(F.col("latest_end") > ts_lit(since)).select("trace_id")
    seen = logs.where((F.col("timestamp") > ts_lit(since)) & TimeRange(since).scan()).select("trace_id")
    return traces.select("trace_id").distinct().join(ended.unionByName(seen), "trace_id", "left_semi")


def in_progress_sessions(logs: DataFrame, spans: DataFrame, since: datetime, ids: DataFrame | None = None,
                         kept: Summaries | None = None) -> DataFrame:
    """Sessions whose latest prompt's trace has no root yet and was active since."""
    kept = kept or Summaries.of(spans=spans, logs=logs)
    latest = (_only(kept.session_logs, ids).groupBy("session_id").agg(F.max("latest").alias("m"))
              .select("session_id", E.real_trace_id(F.col("m.trace_id")).alias("trace_id")).where("trace_id IS NOT NULL"))
    open_ = latest.join(kept.traces.where("has_interaction").select("trace_id"), "trace_id", "left_anti")
    return open_.join(active_traces(kept, logs, since, open_), "trace_id").select("session_id").distinct()


def background_active(logs: DataFrame, spans: DataFrame, since: datetime, ids: DataFrame | None = None,
                      grace_seconds: float = BACKGROUND_GRACE_SECONDS, kept: Summaries | None = None) -> DataFrame:
    """Traces still logging well after a root span of theirs closed."""
    rows = _only(logs.where((F.col("timestamp") > ts_lit(since)) & TimeRange(since).scan() & F.col("session_id").isNotNull()), ids)
    # One row per (session, trace) is enough: only its latest log can be the late one.
    last = rows.groupBy("session_id", "trace_id").agg(F.max("timestamp").alias("timestamp"))
    days = (kept or Summaries.of(spans=spans)).traces.where("closed_at IS NOT NULL").join(last.select("trace_id").distinct(), "trace_id", "left_semi")
    closed = days.groupBy("trace_id").agg(F.min("closed_at").alias("closed_at"))
    late = F.unix_micros("timestamp") > F.unix_micros("closed_at") + F.lit(int(grace_seconds * 1e6))
    return last.join(closed, "trace_id").where(late).select("session_id", "trace_id")


def turn_progress(spans: DataFrame, logs: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    closed = _only(spans, traces, "trace_id").groupBy("trace_id").agg(F.count_if(F.col("parent_span_id").isNull()).alias("roots"))
    return (trace_activity(spans, logs, traces).join(closed, "trace_id", "left")
            .select("trace_id", (F.coalesce("roots", F.lit(0)) > 0).alias("root_closed"), "last_activity"))
