"""This period against the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange
from spanloom.functions import expr as E
from spanloom.functions.skew import cut_lineage
from spanloom.functions.timebins import bin_index
from spanloom.operators.cost import sum_when
from spanloom.operators.tools import failed
from spanloom.sources.summaries import Summaries

POINTS = 7
FLAT = 2.0

# Which way each figure should move.
GOOD_DIRECTION = {
    "total_cost": "down", "cost_per_session": "down", "blended_rate_per_1m": "down",
    "cache_read_ratio_pct": "up", "tokens_total": "down", "tokens_per_session": "down",
    "tool_errors": "down", "error_rate_pct": "down", "session_failures": "down",
    "sessions": "up", "avg_duration_min": "down",
}
SECTIONS = {
    "cost": ("total_cost", "cost_per_session", "blended_rate_per_1m"),
    "token_efficiency": ("cache_read_ratio_pct", "tokens_total", "tokens_per_session"),
    "reliability": ("tool_errors", "error_rate_pct", "session_failures"),
    "activity": ("sessions", "avg_duration_min"),
}
_PERCENTAGE_POINTS = ("cache_read_ratio_pct", "error_rate_pct")


def bucket_seconds(w: TimeRange, points: int = POINTS) -> int:
    return max(60, int(w.seconds) // points)


def period(w: TimeRange) -> Column:
    return F.when(w.contains(), "current").when(w.prior(), "prior")


def period_bin(w: TimeRange, seconds: int) -> Column:
    """Bin number inside the row's own period."""
    return F.when(w.contains(), bin_index("timestamp", w.start, seconds)).otherwise(bin_index("timestamp", w.prior_start, seconds))


def _is_cost(cfg: TelemetryConfig) -> Column:
    return (F.col("metric_name") == cfg.cost_metric) & F.col("session_id").isNotNull() & F.col("value_double").isNotNull()


def _moving(points: DataFrame, w: TimeRange, names: tuple[str, ...], repo: str | None) -> DataFrame:
    return points.where(F.col("metric_name").isin(*names) & E.moving() & w.scan() & E.in_repository(repo))


def totals_current_prior(points: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    both = [sum_when(w.contains()).alias("current_total"), sum_when(w.prior()).alias("prior_total")]
    rows = _moving(points, w.with_prior(), (cfg.cost_metric, cfg.token_metric), repo)
    none = F.lit(None).cast("string").alias("token_type")
    cost = rows.where(_is_cost(cfg)).agg(*both).select(F.lit("cost").alias("row_type"), none, "current_total", "prior_total")
    tokens = rows.where(F.col("metric_name") == cfg.token_metric)
    total = tokens.agg(*both).select(F.lit("token_total").alias("row_type"), none, "current_total", "prior_total")
    by_type = tokens.groupBy("token_type").agg(*both).select(F.lit("token_type").alias("row_type"), "token_type", "current_total", "prior_total")
    return cost.unionByName(total).unionByName(by_type)


def _lengths(kept: Summaries, repo: str | None, sessions: DataFrame) -> DataFrame:
    """Whole-life length of some sessions, in seconds: from the first point that moved, and from the first of any kind."""
    life = kept.session_lives(repo, sessions)
    return life.select("session_id", *[((F.unix_micros("last_moved") - F.unix_micros(c)) / 1e6).alias(n)
                                       for c, n in (("first_moved", "seconds"), ("first_any", "seconds_any"))])


def _moved_sessions(points: DataFrame, w: TimeRange, columns: dict[str, Column], repo: str | None, cfg: TelemetryConfig) -> DataFrame:
    """The distinct sessions of each period or bin that they moved in; a narrow table, read twice by its users."""
    rows = _moving(points, w, (cfg.cost_metric, cfg.active_metric), repo).where(F.col("session_id").isNotNull())
    return cut_lineage(rows.select("session_id", *[c.alias(n) for n, c in columns.items()]).distinct())


def sessions_current_prior(points: DataFrame, w: TimeRange, repo: str | None = None, kept: Summaries | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    return _session_bins(points, w.with_prior(), {"period": period(w)}, repo, "seconds", kept, cfg)


def _session_bins(points: DataFrame, w: TimeRange, bin_columns: dict[str, Column], repo: str | None, seconds: str,
                  kept: Summaries | None, cfg: TelemetryConfig) -> DataFrame:
    """Sessions that moved in a bin, counted with their whole-life length."""
    present = _moved_sessions(points, w, bin_columns, repo, cfg)
    lengths = _lengths(kept or Summaries.of(points=points, cfg=cfg), repo, present)
    return (present.join(lengths, "session_id").groupBy(*bin_columns)
            .agg(E.row_count().alias("session_count"), F.avg(seconds).alias("avg_duration_seconds")))


def sparklines_combined(points: DataFrame, w: TimeRange, seconds: int, repo: str | None = None, kept: Summaries | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    both = w.with_prior()
    bins = {"period": period(w), "bucket_index": period_bin(w, seconds)}
    sums = (_moving(points, both, (cfg.cost_metric, cfg.token_metric), repo).groupBy(*[c.alias(n) for n, c in bins.items()])
            .agg(sum_when(F.col("metric_name") == cfg.cost_metric).alias("cost_total"),
                 E.rounded_long(sum_when(F.col("metric_name") == cfg.token_metric)).alias("token_total")))
    sessions = _session_bins(points, both, bins, repo, "seconds", kept, cfg)
    return sums.join(sessions, ["period", "bucket_index"], "full").na.fill(0).orderBy("period", "bucket_index")


def token_type_sparklines(points: DataFrame, w: TimeRange, seconds: int, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    return (_moving(points, w.with_prior(), (cfg.token_metric,), repo)
            .groupBy(period(w).alias("period"), period_bin(w, seconds).alias("bucket_index"), "token_type")
            .agg(E.rounded_long(F.sum("value_delta")).alias("total")))


def cost_token_trend(points: DataFrame, w: TimeRange, seconds: int, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = points.where(F.col("metric_name").isin(cfg.cost_metric, cfg.token_metric) & w.scan())
    return (rows.groupBy(bin_index("timestamp", w.start, seconds).alias("bucket_index"))
            .agg(sum_when(F.col("metric_name") == cfg.cost_metric).alias("cost_total"),
                 E.rounded_long(sum_when(F.col("metric_name") == cfg.token_metric)).alias("token_total")).orderBy("bucket_index"))


def token_type_trend(points: DataFrame, w: TimeRange, seconds: int, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = points.where((F.col("metric_name") == cfg.token_metric) & w.scan())
    return (rows.groupBy(bin_index("timestamp", w.start, seconds).alias("bucket_index"), "token_type")
            .agg(E.rounded_long(F.coalesce(F.sum("value_delta"), F.lit(0.0))).alias("total")))


def session_trend(points: DataFrame, w: TimeRange, seconds: int, repo: str | None = None, kept: Summaries | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    bins = {"bucket_index": bin_index("timestamp", w.start, seconds)}
    return _session_bins(points, w, bins, repo, "seconds_any", kept, cfg).orderBy("bucket_index")


def _tool_rows(logs: DataFrame, w: TimeRange, repo: str | None, cfg: TelemetryConfig) -> DataFrame:
    return logs.where((F.col("event_name") == cfg.tool_result) & w.scan() & E.in_repository(repo))


def tool_failure_current_prior(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    now, before = w.contains(), w.prior()
    return _tool_rows(logs, w.with_prior(), repo, cfg).agg(
        F.count_if(now).alias("current_calls"), F.count_if(now & failed()).alias("current_failures"),
        F.count_if(before).alias("prior_calls"), F.count_if(before & failed()).alias("prior_failures"))


def tool_failure_trend(logs: DataFrame, w: TimeRange, seconds: int, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    return (_tool_rows(logs, w, repo, cfg).groupBy(bin_index("timestamp", w.start, seconds).alias("bucket_index"))
            .agg(E.row_count().alias("total_calls"), F.count_if(failed()).alias("failures")).orderBy("bucket_index"))


def session_failures_current_prior(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    per = (_tool_rows(logs, w.with_prior(), repo, cfg).where(failed() & F.col("session_id").isNotNull())
           .groupBy("session_id").agg(F.max(w.contains()).alias("now"), F.max(w.prior()).alias("before")))
    return per.agg(F.count_if("now").alias("current_session_failures"), F.count_if("before").alias("prior_session_failures"))


def session_failures_trend(logs: DataFrame, w: TimeRange, seconds: int, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = _tool_rows(logs, w, repo, cfg).where(failed())
    return (rows.groupBy(bin_index("timestamp", w.start, seconds).alias("bucket_index"))
            .agg(F.countDistinct("session_id").alias("failed_sessions")).orderBy("bucket_index"))


def _ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    return F.when(bottom != 0, top / bottom * scale).otherwise(F.lit(0.0))


def _figures() -> dict[str, Column]:
    """Every figure from the sums of one (period) or one (period, bin)."""
    c = F.col
    side = c("tokens_input") + c("tokens_creation") + c("tokens_read")
    return {
        "total_cost": c("cost"), "cost_per_session": _ratio(c("cost"), c("sessions")),
        "blended_rate_per_1m": _ratio(c("cost"), c("tokens"), 1e6),
        "cache_read_ratio_pct": _ratio(c("tokens_read"), side, 100.0), "tokens_total": c("tokens"),
        "tokens_per_session": _ratio(c("tokens"), c("sessions")),
        "tool_errors": c("failures").cast("double"), "error_rate_pct": _ratio(c("failures"), c("calls"), 100.0),
        "session_failures": c("failed_sessions").cast("double"), "sessions": c("sessions").cast("double"),
        "avg_duration_min": c("duration") / 60.0,
    }


def _sums(points: DataFrame, logs: DataFrame, w: TimeRange, seconds: int | None, repo: str | None, kept: Summaries | None, cfg: TelemetryConfig) -> DataFrame:
    """Sums per period, or per period and bin, of all the figures' inputs."""
    both = w.with_prior()
    keys = {"period": period(w)}
    if seconds is not None:
        keys["bucket_index"] = period_bin(w, seconds)
    names = list(keys)
    columns = [c.alias(n) for n, c in keys.items()]
    is_token = F.col("metric_name") == cfg.token_metric
    # The period totals leave out cost points without a session; the series keep them.
    is_cost = _is_cost(cfg) if seconds is None else F.col("metric_name") == cfg.cost_metric

    def of_type(kind: str) -> Column:
        return sum_when(is_token & (F.col("token_type") == kind))

    money = _moving(points, both, (cfg.cost_metric, cfg.token_metric), repo).groupBy(*columns).agg(
        sum_when(is_cost).alias("cost"), sum_when(is_token).alias("tokens"), of_type("input").alias("tokens_input"),
        of_type("cacheCreation").alias("tokens_creation"), of_type("cacheRead").alias("tokens_read"))
    # A session's series starts at its first row of any kind, its totals at the first that moved.
    sessions = _session_bins(points, both, keys, repo, "seconds" if seconds is None else "seconds_any", kept, cfg).withColumnsRenamed(
        {"session_count": "sessions", "avg_duration_seconds": "duration"})
    tools = _tool_rows(logs, both, repo, cfg)
    calls = tools.groupBy(*columns).agg(E.row_count().alias("calls"), F.count_if(failed()).alias("failures"))
    bad = tools.where(failed()).groupBy(*columns).agg(F.countDistinct("session_id").alias("failed_sessions"))
    out = money.join(sessions, names, "full").join(calls, names, "full").join(bad, names, "full")
    return out.na.fill(0)


def trends(points: DataFrame, logs: DataFrame, w: TimeRange, section: str | None = None, repo: str | None = None,
           kept: Summaries | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Before and after of the eleven figures, with the verdict on the change."""
    metrics = SECTIONS[section] if section else tuple(GOOD_DIRECTION)
    sums = _sums(points, logs, w, None, repo, kept, cfg)
    figures = {k: v for k, v in _figures().items() if k in metrics}
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in figures.items()])
    long = sums.select("period", F.inline(entries))
    zero = F.lit(0.0)
    wide = long.groupBy("metric").agg(
        F.coalesce(F.max(F.when(F.col("period") == "prior", F.col("value"))), zero).alias("before"),
        F.coalesce(F.max(F.when(F.col("period") == "current", F.col("value"))), zero).alias("after"))
    good = F.create_map(*[F.lit(x) for kv in GOOD_DIRECTION.items() for x in kv])[F.col("metric")]
    return delta_verdict(wide.withColumn("good_direction", good))


def trend_series(points: DataFrame, logs: DataFrame, w: TimeRange, section: str | None = None, bins: int = POINTS,
                 repo: str | None = None, kept: Summaries | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Dense bins of each figure in both periods; rows past the last bin are left out."""
    metrics = SECTIONS[section] if section else tuple(GOOD_DIRECTION)
    sums = _sums(points, logs, w, bucket_seconds(w, bins), repo, kept, cfg).where(F.col("bucket_index") < bins)
    figures = {k: v for k, v in _figures().items() if k in metrics}
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in figures.items()])
    long = sums.select("period", "bucket_index", F.inline(entries))
    spark = points.sparkSession
    axis = (spark.createDataFrame([(m, p) for m in figures for p in ("prior", "current")], "metric string, period string")
            .select("metric", "period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bucket_index")))
    return axis.join(long, ["metric", "period", "bucket_index"], "left").na.fill(0.0)


def delta_verdict(df: DataFrame) -> DataFrame:
    """Percentage points for ratios, percent otherwise; small changes are flat."""
    before, after = F.col("before"), F.col("after")
    percent = (F.when(before != 0, (after - before) / F.abs(before) * 100.0).when(after == 0, 0.0).otherwise(100.0))
    delta = F.when(F.col("metric").isin(*_PERCENTAGE_POINTS), after - before).otherwise(percent)
    direction = F.when(F.abs(F.col("delta")) < FLAT, "flat").when(F.col("delta") > 0, "up").otherwise("down")
    total = F.abs(before) + F.abs(after)
    return (df.withColumn("delta", delta).withColumn("direction", direction)
            .withColumn("verdict", F.when(F.col("direction") == "flat", "flat")
                        .when(F.col("direction") == F.col("good_direction"), "good").otherwise("bad"))
            .withColumn("before_share_percent", F.when(total > 0, F.abs(before) / total * 100.0).otherwise(50.0)))
