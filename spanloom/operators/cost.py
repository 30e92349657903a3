"""Cost from request logs, cost from counters, and the figures built on each. The two never mix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange
from spanloom.functions import expr as E
from spanloom.functions.skew import first_rows
from spanloom.functions.timebins import bin_axis, bin_ts
from spanloom.operators import tools

CATEGORIES = ("MAIN_LOOP", "SUBAGENT", "SKILL", "AUXILIARY")
HOURS_PER_30_DAYS = 720.0
TOP_SESSIONS = 10
_TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def requests(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    return logs.where((F.col("event_name") == cfg.api_request) & w.scan() & E.in_repository(repo))


def usd(column: str = "cost_usd") -> Column:
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def _token_sums() -> list[Column]:
    return [F.coalesce(E.rounded_long(F.sum(c)), F.lit(0)).alias(c) for c in _TOKENS]


def _category() -> Column:
    return E.work_category_of("query_source", "has_skill")


def cost_by_category(logs: DataFrame, w: TimeRange, bucket_seconds: int, repo: str | None = None) -> DataFrame:
    """Whole range, per category, and per category and bin, from one scan."""
    rows = requests(logs, w, repo).select(
        _category().alias("category"), bin_ts("timestamp", w.start, bucket_seconds).alias("bucket"), "cost_usd", *_TOKENS)
    return (rows.groupingSets([[], [F.col("category")], [F.col("category"), F.col("bucket")]], "category", "bucket")
            .agg(F.grouping("category").alias("category_grouped"), F.grouping("bucket").alias("bucket_grouped"),
                 usd().alias("cost_usd"), E.row_count().alias("requests"), *_token_sums()))


def prior_cost(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    before = TimeRange(w.prior_start, w.start)
    rows = logs.where((F.col("event_name") == cfg.api_request) & before.scan(half_open=True) & E.in_repository(repo))
    return rows.agg(usd().alias("prior_total"))


def cost_by_model_effort(logs: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    model = F.coalesce(E.blank_to_null("model"), F.lit("unknown")).alias("model")
    return (requests(logs, w, repo).groupBy(model, "effort")
            .agg(usd().alias("cost_usd"), E.row_count().alias("requests"), *_token_sums())
            .orderBy(F.desc("cost_usd"), "model", "effort"))


def top_cost_sessions(logs: DataFrame, w: TimeRange, n: int | None = TOP_SESSIONS, repo: str | None = None) -> DataFrame:
    found = (requests(logs, w, repo).where(F.col("session_id").isNotNull()).groupBy("session_id")
             .agg(usd().alias("cost_usd"), E.row_count().alias("requests")))
    return first_rows(found.orderBy(F.desc("cost_usd"), "session_id"), n)


def session_category_cost(logs: DataFrame, w: TimeRange, sessions: DataFrame, repo: str | None = None) -> DataFrame:
    rows = requests(logs, w, repo).join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return rows.groupBy("session_id").agg(*[
        F.coalesce(F.sum(F.when(_category() == c, F.col("cost_usd"))).cast("double"), F.lit(0.0)).alias(f"{c.lower()}_usd")
        for c in CATEGORIES])


def change_percent(current: Column, prior: Column, empty: float | None = 0.0) -> Column:
    return F.when(prior != 0, (current - prior) / prior * 100.0).otherwise(F.lit(empty).cast("double"))


def cost_headline(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Both windows in one scan: totals, change, hourly burn and 30-day projection."""
    now = w.contains()
    rows = logs.where((F.col("event_name") == cfg.api_request) & w.with_prior().scan() & E.in_repository(repo))
    hours = max(1.0, float(int(w.seconds))) / 3600.0
    sums = rows.agg(
        F.coalesce(F.sum(F.when(now, F.col("cost_usd"))).cast("double"), F.lit(0.0)).alias("current_usd"),
        F.coalesce(F.sum(F.when(w.prior(), F.col("cost_usd"))).cast("double"), F.lit(0.0)).alias("prior_usd"),
        F.count_if(now).alias("requests"),
        *[F.coalesce(E.rounded_long(F.sum(F.when(now, F.col(c)))), F.lit(0)).alias(c) for c in _TOKENS])
    return (sums.withColumn("delta_percent", change_percent(F.col("current_usd"), F.col("prior_usd")))
            .withColumn("burn_usd_per_hour", F.col("current_usd") / hours)
            .withColumn("projected_30d_usd", F.col("current_usd") / hours * HOURS_PER_30_DAYS))


def integer_share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.floor(part / whole * 100.0 + 0.5)).otherwise(0).cast("long")


def identifier_shares(cost_rows: DataFrame) -> DataFrame:
    """Cost per identifier with its share of the identified total."""
    per = cost_rows.groupBy("identifier").agg(F.sum("cost_usd").alias("cost_usd"))
    total = per.agg(F.sum("cost_usd")).scalar()
    return (per.withColumn("share_percent", integer_share(F.col("cost_usd"), total))
            .orderBy(F.desc("cost_usd"), "identifier"))


def category_shares(logs: DataFrame, spans: DataFrame, w: TimeRange, repo: str | None = None,
                    cfg: TelemetryConfig = CFG) -> DataFrame:
    per = (requests(logs, w, repo).groupBy(_category().alias("category"))
           .agg(usd().alias("cost_usd"), E.row_count().alias("requests")))
    total = per.agg(F.sum("cost_usd")).scalar()
    subagents = tools.subagent_cost(logs, spans, w, repo, cfg).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).scalar()
    skills = tools.skill_cost(logs, w, repo).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).scalar()
    return (per.withColumn("share_percent", integer_share(F.col("cost_usd"), total))
            .withColumn("identified_usd", F.when(F.col("category") == "SUBAGENT", subagents)
                        .when(F.col("category") == "SKILL", skills))
            .orderBy(F.desc("cost_usd"), "category"))


def cost_trend_series(logs: DataFrame, w: TimeRange, bucket_seconds: int, repo: str | None = None) -> DataFrame:
    """One column per category in fixed order; a bin in which a category spent nothing holds 0."""
    rows = requests(logs, w, repo).groupBy(bin_ts("timestamp", w.start, bucket_seconds).alias("bucket"))
    return rows.agg(*[F.coalesce(F.sum(F.when(_category() == c, F.col("cost_usd"))).cast("double"), F.lit(0.0))
                      .alias(c.lower()) for c in CATEGORIES]).orderBy("bucket")


def model_mix(model_effort: DataFrame) -> DataFrame:
    return model_effort.groupBy("model").agg(F.sum("cost_usd").alias("cost_usd")).orderBy(F.desc("cost_usd"), "model")


def top_session_shares(logs: DataFrame, w: TimeRange, n: int | None = TOP_SESSIONS, repo: str | None = None) -> DataFrame:
    from spanloom.operators.sessions import first_prompts

    top = top_cost_sessions(logs, w, n, repo)
    return (top.join(session_category_cost(logs, w, top, repo), "session_id", "left")
            .join(first_prompts(logs, top), "session_id", "left").orderBy(F.desc("cost_usd"), "session_id"))


@dataclass(frozen=True)
class CostBreakdown:
    headline: DataFrame
    categories: DataFrame
    subagents: DataFrame
    skills: DataFrame
    trend: DataFrame
    model_effort: DataFrame
    models: DataFrame
    sessions: DataFrame


def cost_breakdown(logs: DataFrame, spans: DataFrame, w: TimeRange, repo: str | None = None, bins: int = 14,
                   cfg: TelemetryConfig = CFG) -> CostBreakdown:
    seconds = max(60, int(w.seconds) // bins)
    grid = cost_by_model_effort(logs, w, repo)
    return CostBreakdown(
        cost_headline(logs, w, repo), category_shares(logs, spans, w, repo, cfg),
        identifier_shares(tools.subagent_cost(logs, spans, w, repo, cfg)), identifier_shares(tools.skill_cost(logs, w, repo)),
        cost_trend_series(logs, w, seconds, repo), grid, model_mix(grid), top_session_shares(logs, w, repo=repo))


# Counter-based cost.

def cost_points(points: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    return points.where((F.col("metric_name") == cfg.cost_metric) & F.col("session_id").isNotNull()
                        & F.col("value_double").isNotNull() & E.moving() & w.scan() & E.in_repository(repo))


def sum_when(test: Column, value: str = "value_delta") -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0.0))


def counter_cost_current_prior(points: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    rows = cost_points(points, w.with_prior(), repo)
    return rows.agg(sum_when(w.contains()).alias("current_total"), sum_when(w.prior()).alias("prior_total"))


def counter_cost_breakdown(points: DataFrame, w: TimeRange, bucket_seconds: int, repo: str | None = None) -> DataFrame:
    rows = cost_points(points, w, repo).select(
        bin_ts("timestamp", w.start, bucket_seconds).alias("bucket"),
        F.coalesce("model", F.lit("unknown")).alias("model"), "value_delta")
    kind = (F.when(F.grouping("model") == 0, "model").when(F.grouping("bucket") == 0, "bucket").otherwise("total"))
    return (rows.groupingSets([[], [F.col("bucket")], [F.col("model")]], "bucket", "model")
            .agg(kind.alias("row_type"), F.coalesce(F.sum("value_delta"), F.lit(0.0)).alias("amount")))


def cost_summary(points: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Spend, change, burn, projection and price per 1000 tokens in one row."""
    hours = max(1.0, float(int(w.seconds))) / 3600.0
    is_cost = ((F.col("metric_name") == cfg.cost_metric) & F.col("session_id").isNotNull() & F.col("value_double").isNotNull())
    is_token = F.col("metric_name") == cfg.token_metric
    rows = points.where(F.col("metric_name").isin(cfg.cost_metric, cfg.token_metric) & E.moving()
                        & w.with_prior().scan() & E.in_repository(repo))
    sums = rows.agg(sum_when(is_cost & w.contains()).alias("spend_usd"), sum_when(is_cost & w.prior()).alias("prior_usd"),
                    E.rounded_long(sum_when(is_token & w.contains())).alias("total_tokens"))
    return (sums.withColumn("delta_percent", change_percent(F.col("spend_usd"), F.col("prior_usd")))
            .withColumn("burn_usd_per_hour", F.col("spend_usd") / hours)
            .withColumn("projected_30d_usd", F.col("spend_usd") / hours * HOURS_PER_30_DAYS)
            .withColumn("cost_per_1k_tokens", F.when(F.col("total_tokens") > 0, F.col("spend_usd") / (F.col("total_tokens") / 1000.0))
                        .otherwise(0.0)))


def cost_summary_trend(points: DataFrame, w: TimeRange, bins: int = 14, repo: str | None = None) -> DataFrame:
    seconds = max(1, int(w.seconds) // bins)
    sums = (cost_points(points, w, repo).groupBy(bin_ts("timestamp", w.start, seconds).alias("bucket"))
            .agg(F.sum("value_delta").alias("cost_usd")))
    return bin_axis(points.sparkSession, w, seconds).join(sums, "bucket", "left").na.fill(0.0).orderBy("bucket")


def cost_summary_models(points: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    per = (cost_points(points, w, repo).groupBy(F.coalesce("model", F.lit("unknown")).alias("model"))
           .agg(F.sum("value_delta").alias("cost_usd")))
    total = per.agg(F.sum("cost_usd")).scalar()
    return per.withColumn("share_percent", integer_share(F.col("cost_usd"), total)).orderBy(F.desc("cost_usd"), "model")


# Cost of spans and traces, from the requests logged in them.

def _priced(logs: DataFrame, cfg: TelemetryConfig) -> DataFrame:
    return logs.where((F.col("event_name") == cfg.api_request) & F.col("cost_usd").isNotNull())


def span_costs(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    return (_priced(logs, cfg).where(F.col("span_id").isNotNull()).groupBy("trace_id", "span_id")
            .agg(F.sum("cost_usd").alias("cost_usd")))


def trace_costs(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    return (_priced(logs, cfg).where(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(F.sum("cost_usd").alias("cost_usd")))


def span_efforts(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    calls = spans.where((F.col("name") == cfg.llm_span) & F.col("request_id").isNotNull()).select("trace_id", "span_id", "request_id")
    efforts = (logs.where((F.col("event_name") == cfg.api_request) & F.col("request_id").isNotNull()
                          & E.blank_to_null("effort").isNotNull()).select("request_id", "effort"))
    return calls.join(efforts, "request_id").select("trace_id", "span_id", "effort")
