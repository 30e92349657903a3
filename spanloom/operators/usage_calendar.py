"""Usage per local day and hour."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange
from spanloom.functions import expr as E
from spanloom.functions.timebins import local_time
from spanloom.operators.cost import sum_when
from spanloom.operators.tools import skill_invocations

HEAT_FLOOR, HEAT_SPAN = 6.0, 16.0
ACTIVE_FLOOR_SECONDS = 1


def _day(zone: str, ts: str = "timestamp") -> Column:
    return F.to_date(local_time(ts, zone)).cast("string").alias("day")


def _hour(zone: str, ts: str = "timestamp") -> Column:
    return F.hour(local_time(ts, zone)).cast("long").alias("hour")


def _whole(column: str) -> Column:
    """A sum as a whole number; the sum's own rounding noise is taken off first."""
    return E.rounded_long(F.round(column, 6))


def _counters(points: DataFrame, w: TimeRange, names: tuple[str, ...], repo: str | None) -> DataFrame:
    return points.where(F.col("metric_name").isin(*names) & E.moving() & w.scan(half_open=True) & E.in_repository(repo))


def _of(metric: str) -> Column:
    return sum_when(F.col("metric_name") == metric)


def daily_counters(points: DataFrame, w: TimeRange, zone: str, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    names = (cfg.cost_metric, cfg.token_metric, cfg.active_metric, cfg.commit_metric, cfg.pull_request_metric)
    seen = F.col("metric_name").isin(cfg.cost_metric, cfg.active_metric)
    rows = _counters(points, w, names, repo).withColumn("day", _day(zone))
    sums = rows.groupBy("day").agg(
        _of(cfg.cost_metric).alias("cost_usd"), _of(cfg.token_metric).alias("tokens"), _of(cfg.active_metric).alias("active_seconds"),
        _of(cfg.commit_metric).alias("commits"), _of(cfg.pull_request_metric).alias("pull_requests"))
    sessions = rows.where(seen).groupBy("day").agg(F.countDistinct("session_id").alias("sessions"))
    return sums.join(sessions, "day", "left").na.fill(0)


def daily_splits(points: DataFrame, w: TimeRange, zone: str, repo: str | None = None, cfg: TelemetryConfig = CFG,
                 line_types: tuple[str, str] = ("added", "removed")) -> DataFrame:
    rows = _counters(points, w, (cfg.lines_metric, cfg.edit_decision_metric), repo)
    lines, edits = F.col("metric_name") == cfg.lines_metric, F.col("metric_name") == cfg.edit_decision_metric
    return rows.groupBy(_day(zone)).agg(
        sum_when(lines & (F.col("token_type") == line_types[0])).alias("lines_added"),
        sum_when(lines & (F.col("token_type") == line_types[1])).alias("lines_removed"),
        sum_when(edits & (F.col("decision") == "accept")).alias("decisions_accepted"),
        sum_when(edits & (F.col("decision") == "reject")).alias("decisions_rejected"))


def daily_cost_by_model(points: DataFrame, w: TimeRange, zone: str, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    return (_counters(points, w, (cfg.cost_metric,), repo).groupBy(_day(zone), "model").agg(F.sum("value_delta").alias("cost_usd"))
            .where("cost_usd > 0").orderBy("day", F.desc("cost_usd"), "model"))


def hourly_counters(points: DataFrame, w: TimeRange, zone: str, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = _counters(points, w, (cfg.cost_metric, cfg.token_metric, cfg.active_metric), repo)
    return rows.groupBy(_day(zone), _hour(zone)).agg(
        _of(cfg.cost_metric).alias("cost_usd"), _of(cfg.token_metric).alias("tokens"), _of(cfg.active_metric).alias("active_seconds"))


def daily_skill_invocations(logs: DataFrame, w: TimeRange, zone: str, repo: str | None = None) -> DataFrame:
    return (skill_invocations(logs, w, repo, half_open=True).groupBy(_day(zone, "turn_at")).agg(E.row_count().alias("invocations")))


def hourly_skill_invocations(logs: DataFrame, w: TimeRange, zone: str, repo: str | None = None) -> DataFrame:
    return (skill_invocations(logs, w, repo, half_open=True)
            .groupBy(_day(zone, "turn_at"), _hour(zone, "turn_at")).agg(E.row_count().alias("invocations")))


def daily_subagent_dispatches(logs: DataFrame, w: TimeRange, zone: str, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.tool_result) & (F.col("tool_name") == cfg.subagent_tool)
                      & w.scan(half_open=True) & E.in_repository(repo))
    return rows.groupBy(_day(zone)).agg(E.row_count().alias("dispatches"))


def _axis(points: DataFrame, first: date, last: date) -> DataFrame:
    days = (last - first).days + 1
    return points.sparkSession.range(0, days, 1, 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).cast("string").alias("day"))


def usage_calendar(points: DataFrame, logs: DataFrame, w: TimeRange, first: date, last: date, zone: str,
                   repo: str | None = None) -> DataFrame:
    """Every day from ``first`` to ``last``, empty days as zeros."""
    out = _axis(points, first, last)
    for part in (daily_counters(points, w, zone, repo), daily_splits(points, w, zone, repo),
                 daily_skill_invocations(logs, w, zone, repo).withColumnRenamed("invocations", "skill_calls"),
                 daily_subagent_dispatches(logs, w, zone, repo).withColumnRenamed("dispatches", "subagent_calls")):
        out = out.join(part, "day", "left")
    whole = ("tokens", "active_seconds", "commits", "pull_requests", "lines_added", "lines_removed", "decisions_accepted", "decisions_rejected")
    return out.na.fill(0).withColumns({c: _whole(c) for c in whole}).orderBy("day")


def usage_calendar_hours(points: DataFrame, logs: DataFrame, w: TimeRange, first: date, last: date, zone: str,
                         repo: str | None = None) -> DataFrame:
    out = _axis(points, first, last).select("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    out = out.join(hourly_counters(points, w, zone, repo), ["day", "hour"], "left")
    out = out.join(hourly_skill_invocations(logs, w, zone, repo).withColumnRenamed("invocations", "skill_calls"), ["day", "hour"], "left")
    return out.na.fill(0).withColumns({c: _whole(c) for c in ("tokens", "active_seconds")}).orderBy("day", "hour")


def is_active_day() -> Column:
    test = F.col("active_seconds") >= ACTIVE_FLOOR_SECONDS
    for c in ("cost_usd", "tokens", "skill_calls", "subagent_calls", "sessions"):
        test = test | (F.col(c) > 0)
    return test


def calendar_heat(days: DataFrame, today: str, color_by: str = "cost_usd") -> DataFrame:
    """Shade of each active elapsed day, scaled between the lowest and highest of them."""
    active = days.where((F.col("day") <= today) & is_active_day())
    low, high = active.agg(F.min(color_by)).scalar(), active.agg(F.max(color_by)).scalar()
    spread = F.when(high - low == 0, 1.0).otherwise(high - low)
    return active.select("day", (F.lit(HEAT_FLOOR) + (F.col(color_by) - low) / spread * HEAT_SPAN).alias("heat_percent"))


def period_totals(days: DataFrame, today: str) -> DataFrame:
    return days.where(F.col("day") <= today).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("skill_calls"), F.lit(0)).alias("skill_calls"), F.count_if(is_active_day()).alias("active_days"),
        E.row_count().alias("elapsed_days"))


def period_change(current_days: DataFrame, prior_days: DataFrame, today: str) -> DataFrame:
    """Totals next to the same number of days of the prior period; no change where that has nothing."""
    now = period_totals(current_days, today)
    elapsed = now.select("elapsed_days").scalar()
    start = prior_days.agg(F.min("day")).scalar()
    like = prior_days.where(F.datediff(F.to_date("day"), F.to_date(start)) < elapsed)
    before = period_totals(like, "9999-12-31")

    def change(c: str) -> Column:
        prior = before.select(c).scalar()
        return F.when(prior > 0, (F.col(c) - prior) / prior * 100.0).alias(f"{c}_change_percent")

    return now.select("*", *[change(c) for c in ("cost_usd", "tokens", "skill_calls")])
