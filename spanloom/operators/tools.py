"""Tool activity: calls, latency, context footprint, failures, repeats, MCP, subagents, skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange
from spanloom.functions import expr as E
from spanloom.functions.skew import carry_last, first_rows, join_nullsafe, percentiles_from, percentiles_of, runs, value_counts
from spanloom.functions.timebins import bin_ts

BYTES_PER_TOKEN = 4
REPEAT_LIMIT = 15
NO_SCOPE = "(no scope)"


def tool_results(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    return logs.where((F.col("event_name") == cfg.tool_result) & w.scan() & E.in_repository(repo))


def aggregated_with_percentiles(rows: DataFrame, keys: list[str], value: str, aggs: dict[str, Column], wanted: dict[str, float],
                                round_even: bool = True, **sums: Column) -> DataFrame:
    """Aggregates per key with exact percentiles of ``value``, from one scan of the rows.

    ``aggs`` are over rows per key and value: ``__v`` the value, ``__n`` its rows, and the ``sums`` asked for.
    """
    counts = value_counts(rows, keys, F.col(value), **sums)
    grouped = counts.groupBy(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]).agg(*[c.alias(name) for name, c in aggs.items()])
    p = percentiles_from(counts, keys, wanted)
    if round_even:
        p = p.withColumns({c: F.bround(F.col(c)) for c in wanted})
    return join_nullsafe(grouped, p, keys)


def counted_calls() -> Column:
    return F.sum("__n")


def counted_mean() -> Column:
    """The mean of a value that is counted."""
    return F.round(F.sum(F.col("__v") * F.col("__n")) / F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))))


def duration_and_output(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, mean and 95th percentile of the duration, and mean output per key."""
    size = F.col("result_bytes")
    return aggregated_with_percentiles(
        rows, keys, "duration_ms", {"calls": counted_calls(), "avg_ms": counted_mean(), "avg_out": F.round(F.sum("bytes") / F.sum("sized"))}, {"p95_ms": 0.95},
        bytes=size, sized=F.when(size.isNotNull(), F.lit(1)))


def tool_calls(logs: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    return tool_results(logs, w, repo).groupBy("tool").agg(E.row_count().alias("calls")).orderBy(F.desc("calls"), "tool")


def tool_calls_timeseries(logs: DataFrame, w: TimeRange, bucket_seconds: int, top_n: int | None = 8,
                          repo: str | None = None) -> DataFrame:
    """Calls per bin and tool; tools beyond the largest ``top_n`` (None: all stay) become one "other" series."""
    counts = (tool_results(logs, w, repo)
              .groupBy(bin_ts("timestamp", w.start, bucket_seconds).alias("bucket"), "tool").agg(E.row_count().alias("calls")))
    totals = counts.groupBy("tool").agg(F.sum("calls").alias("total"))
    top = first_rows(totals.orderBy(F.desc("total"), "tool"), top_n).select("tool", F.lit(True).alias("kept"))
    return (counts.join(top, "tool", "left")
            .groupBy("bucket", F.when(F.col("kept"), F.col("tool")).otherwise("other").alias("tool"))
            .agg(F.sum("calls").alias("calls")).orderBy("bucket", "tool"))


def tool_performance(logs: DataFrame, w: TimeRange) -> DataFrame:
    return duration_and_output(tool_results(logs, w), ["tool"]).orderBy(F.desc("calls"), "tool")


def tool_latency(spans: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    raw = F.col("tool_name")
    label = F.when(raw.startswith(cfg.mcp_prefix), F.concat(F.lit("mcp:"), F.split_part(raw, F.lit("__"), F.lit(2)))).otherwise(raw)
    rows = (spans.where((F.col("scope_name") == cfg.span_scope) & (F.col("name") == cfg.tool_span)
                        & w.scan("start_timestamp") & F.col("duration_nanos").isNotNull()
                        & F.map_contains_key("attributes", F.lit("tool_name")) & E.in_repository(repo))
            .select(label.alias("tool"), "duration_nanos"))
    out = aggregated_with_percentiles(rows, ["tool"], "duration_nanos", {"calls": counted_calls()}, {"p50_nanos": 0.5, "p95_nanos": 0.95}, round_even=False)
    return out.orderBy(F.desc_nulls_last("p95_nanos"), "tool")


def _footprint(rows: DataFrame) -> DataFrame:
    out = aggregated_with_percentiles(rows, ["tool"], "result_bytes", {
        "calls": counted_calls(), "total_bytes": E.rounded_long(F.sum(F.col("__v") * F.col("__n")))}, {"p95_bytes": 0.95})
    return (out.withColumn("p95_bytes", F.col("p95_bytes").cast("long"))
            .withColumn("estimated_tokens", F.floor(F.col("total_bytes") / BYTES_PER_TOKEN).cast("long"))
            .orderBy(F.desc("total_bytes"), "tool"))


def sized_results(logs: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    return tool_results(logs, w, repo).where(F.col("result_bytes").isNotNull())


def tunable(cfg: TelemetryConfig = CFG) -> Column:
    """Leaves out tools whose output size is not ours to tune, and image reads."""
    return (~F.coalesce("tool_name", F.lit("unknown")).isin(*cfg.externally_determined_tools)
            & ~F.coalesce("file_path", F.lit("")).rlike(E.IMAGE_PATH))


def context_footprint(logs: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    return _footprint(sized_results(logs, w, repo))


def tunable_context_footprint(logs: DataFrame, w: TimeRange) -> DataFrame:
    return _footprint(sized_results(logs, w).where(tunable()))


def failed() -> Column:
    return F.coalesce(F.col("success") == "false", F.lit(False))


def failure_rates(logs: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    return (tool_results(logs, w, repo).groupBy("tool").agg(E.row_count().alias("calls"), F.count_if(failed()).alias("failures"))
            .orderBy(F.desc("failures"), F.desc("calls"), "tool"))


def failures_by_signature(logs: DataFrame, w: TimeRange) -> DataFrame:
    a = F.col("attributes")
    rows = tool_results(logs, w).where(failed()).select(
        "tool", F.coalesce(a["error_type"], F.lit("unknown")).alias("error_type"),
        F.coalesce(a["error"], F.lit("")).alias("message"),
        F.coalesce("file_path", "command", F.lit("")).alias("scope"))
    return (rows.groupBy("tool", "error_type", E.error_signature("message").alias("error_signature"))
            .agg(F.min("scope").alias("example_scope"), F.min(E.blank_to_null("message")).alias("example_message"),
                 E.row_count().alias("failures")).orderBy(F.desc("failures"), "tool", "error_type", "error_signature"))


def denials(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.tool_decision) & (F.col("decision") == "reject")
                      & w.scan() & E.in_repository(repo))
    return (rows.groupBy("tool", F.coalesce(F.col("attributes")["source"], F.lit("unknown")).alias("source"))
            .agg(E.row_count().alias("denials")).orderBy(F.desc("denials"), "tool", "source"))


def hook_executions(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    a = F.col("attributes")

    def total(key: str) -> Column:
        return F.sum(F.coalesce(E.number(a[key], "long"), F.lit(0)))

    rows = logs.where((F.col("event_name") == cfg.hook_complete) & w.scan() & E.in_repository(repo))
    return (rows.groupBy(F.coalesce(a["hook_event"], F.lit("unknown")).alias("hook_event"),
                         F.coalesce(a["hook_name"], F.lit("unknown")).alias("hook_name"))
            .agg(E.row_count().alias("total"), total("num_success").alias("successes"), total("num_blocking").alias("blocking_errors"),
                 total("num_non_blocking_error").alias("non_blocking_errors"), total("num_cancelled").alias("cancelled"))
            .orderBy(F.desc("blocking_errors"), F.desc("total"), "hook_event", "hook_name"))


def _repeat_scope() -> Column:
    words = F.split(F.trim(F.regexp_replace("command", r"(?i)^(cd\s+\S+\s*(&&|;)\s*)+", "")), r"\s+")
    two = E.blank_to_null(F.array_join(F.slice(words, 1, 2), " "))
    return (F.when(F.col("tool_name").isin("Edit", "Write", "Read", "MultiEdit"), E.blank_to_null("file_path"))
            .when(F.col("tool_name") == "Bash", two))


def tool_repeats(logs: DataFrame, w: TimeRange, repo: str | None = None, limit: int | None = REPEAT_LIMIT) -> DataFrame:
    """Longest run of the same call per session, then its spread over sessions."""
    events = tool_results(logs, w, repo).select(
        F.coalesce("session_id", F.lit("unknown")).alias("session_id"),
        F.coalesce("tool_name", F.lit("unknown")).alias("tool"),
        F.coalesce(_repeat_scope(), F.lit(NO_SCOPE)).alias("scope"),
        F.coalesce("result_bytes", F.lit(0.0)).alias("result_bytes"), "timestamp", "id")
    numbered = runs(events, ["session_id"], ["timestamp", "id"], ["tool", "scope"], "run")
    by_run = (numbered.where(F.col("scope") != NO_SCOPE).groupBy("session_id", "tool", "scope", "run")
              .agg(E.row_count().alias("run_length"), F.sum("result_bytes").alias("run_bytes")))
    longest = (by_run.groupBy("session_id", "tool", "scope")
               .agg(F.max(F.struct("run_length", "run_bytes")).alias("best"))
               .select("tool", "scope", F.col("best.run_length").alias("longest_run"), F.col("best.run_bytes").alias("bytes"))
               .where("longest_run >= 2"))
    out = aggregated_with_percentiles(longest, ["tool", "scope"], "longest_run", {
        "max_run": F.max("__v").cast("long"), "sessions": counted_calls(),
        "estimated_tokens_burned": E.rounded_long(F.sum("burned") / BYTES_PER_TOKEN)}, {"median_run": 0.5}, burned=F.col("bytes"))
    ordered = (out.withColumn("median_run", F.col("median_run").cast("long"))
               .orderBy(F.desc("estimated_tokens_burned"), F.desc("max_run"), F.desc("median_run"), F.desc("sessions"), "tool", "scope"))
    return first_rows(ordered, limit)


def mcp_calls(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    parameters = F.col("attributes")["tool_parameters"]

    def named(key: str) -> Column:
        return F.coalesce(E.blank_to_null(E.json_text(parameters, key)), F.lit("unknown"))

    return (tool_results(logs, w, repo, cfg).where(F.col("tool_name") == cfg.mcp_tool)
            .select(named("mcp_server_name").alias("server"), named("mcp_tool_name").alias("mcp_tool"),
                    "duration_ms", "result_bytes", failed().alias("failed")))


def mcp_usage(logs: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    rows = mcp_calls(logs, w, repo)
    keys = ["server", "mcp_tool"]
    base = rows.groupBy(*keys).agg(
        E.row_count().alias("calls"), F.count_if("failed").alias("failures"), F.round(F.avg("duration_ms")).alias("avg_ms"),
        E.rounded_long(F.sum("result_bytes")).alias("total_bytes"))
    tails = percentiles_of(rows, keys, {"p95_ms": (F.col("duration_ms"), 0.95), "p95_bytes": (F.col("result_bytes"), 0.95)})
    out = (base.join(tails, keys, "left").withColumn("p95_ms", F.bround("p95_ms"))
           .withColumn("p95_bytes", F.bround("p95_bytes").cast("long")))
    totals = base.groupBy("server").agg(F.sum("calls").alias("server_calls"))
    return out.join(totals, "server").orderBy(F.desc("server_calls"), "server", F.desc("calls"), "mcp_tool")


def mcp_server_rollup(usage: DataFrame) -> DataFrame:
    """Per server: call-weighted mean, the largest of the tools' p95s, failure rate, share of calls."""
    timed = F.when(F.col("avg_ms").isNotNull(), F.col("calls"))
    out = usage.groupBy("server").agg(
        F.sum("calls").alias("calls"), F.sum("failures").alias("failures"), E.row_count().alias("tools"),
        (F.sum(F.col("avg_ms") * F.col("calls")) / F.sum(timed)).alias("mean_ms"),
        F.max("p95_ms").alias("p95_ms"), F.sum("total_bytes").alias("total_bytes"), F.max("p95_bytes").alias("p95_bytes"))
    out = out.withColumn("failure_rate", F.col("failures") / F.col("calls"))
    return with_share(out).orderBy(F.desc("calls"), "server")


def _subagent_type(cfg: TelemetryConfig) -> Column:
    a = F.col("attributes")
    return F.coalesce(E.blank_to_null(a["subagent_type"]), E.blank_to_null(E.json_text(a["tool_input"], "subagent_type")),
                      F.lit(cfg.default_subagent))


def subagent_usage(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Dispatches by type and model of the latest main-loop request before them in the session.

    Only the dispatches are bound to the range and repository; the request may lie outside.
    """
    is_dispatch = ((F.col("event_name") == cfg.tool_result) & (F.col("tool_name") == cfg.subagent_tool)
                   & w.scan() & E.in_repository(repo))
    is_turn = (F.col("event_name") == cfg.api_request) & ~F.col("has_agent")
    upper = TimeRange(None, w.end).scan()
    timeline = (logs.where(upper & (is_dispatch | is_turn))
                .select("session_id", "timestamp", "id", F.coalesce(is_dispatch, F.lit(False)).alias("dispatch"),
                        _subagent_type(cfg).alias("identifier"), "model")
                # At one instant the request counts as earlier than the dispatch.
                .withColumn("later", F.col("dispatch").cast("int")))
    turn = F.when(~F.col("dispatch"), F.struct(E.blank_to_null("model").alias("model")))
    asof = carry_last(timeline, ["session_id"], ["timestamp", "later", "id"], turn, "turn")
    return (asof.where("dispatch")
            .groupBy("identifier", F.coalesce(
                F.when(F.col("session_id").isNotNull(), F.col("turn.model")), F.lit("unknown")).alias("model"))
            .agg(E.row_count().alias("calls")).orderBy("identifier", F.desc("calls"), "model"))


def subagent_cost(logs: DataFrame, spans: DataFrame, w: TimeRange, repo: str | None = None,
                  cfg: TelemetryConfig = CFG) -> DataFrame:
    """Dispatch log, its execution span, the model calls under it, their priced requests."""
    dispatches = (logs.where((F.col("event_name") == cfg.tool_result) & (F.col("tool_name") == cfg.subagent_tool)
                             & w.scan() & E.in_repository(repo) & F.col("tool_use_id").isNotNull())
                  .select("tool_use_id", _subagent_type(cfg).alias("identifier")))
    executions = (spans.where((F.col("name") == cfg.tool_execution_span) & F.col("tool_use_id").isNotNull()
                              & E.in_repository(repo))
                  .select("tool_use_id", F.col("span_id").alias("parent_span_id")))
    calls = (spans.where((F.col("name") == cfg.llm_span) & F.col("request_id").isNotNull())
             .select("parent_span_id", "request_id"))
    priced = (logs.where((F.col("event_name") == cfg.api_request) & F.col("model").isNotNull())
              .select("request_id", "model", "cost_usd"))
    return (dispatches.join(executions, "tool_use_id").join(calls, "parent_span_id").join(priced, "request_id")
            .groupBy("identifier", "model")
            .agg(F.coalesce(F.sum("cost_usd").cast("double"), F.lit(0.0)).alias("cost_usd"))
            .orderBy("identifier", F.desc("cost_usd"), "model"))


def skill_invocations(logs: DataFrame, w: TimeRange, repo: str | None = None, half_open: bool = False,
                      cfg: TelemetryConfig = CFG) -> DataFrame:
    """One row per (skill, prompt), dated and modelled by its earliest turn."""
    rows = logs.where((F.col("event_name") == cfg.api_request) & F.col("has_skill") & ~F.col("has_agent")
                      & w.scan(half_open=half_open) & E.in_repository(repo))
    return (rows.groupBy(F.coalesce(E.blank_to_null("skill_name"), F.lit("unknown")).alias("identifier"),
                         F.coalesce(E.blank_to_null("prompt_id"), F.col("id").cast("string")).alias("prompt_id"))
            .agg(F.min(F.struct("timestamp", "id", F.coalesce(E.blank_to_null("model"), F.lit("unknown")).alias("model"))).alias("m"))
            .select("identifier", "prompt_id", F.col("m.model").alias("model"), F.col("m.timestamp").alias("turn_at")))


def skill_usage(logs: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    return (skill_invocations(logs, w, repo).groupBy("identifier", "model").agg(E.row_count().alias("calls"))
            .orderBy("identifier", F.desc("calls"), "model"))


def skill_cost(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.api_request) & F.col("has_skill") & w.scan() & E.in_repository(repo))
    return (rows.groupBy(F.coalesce(E.blank_to_null("skill_name"), F.lit("unknown")).alias("identifier"),
                         F.coalesce(E.blank_to_null("model"), F.lit("unknown")).alias("model"))
            .agg(F.coalesce(F.sum("cost_usd").cast("double"), F.lit(0.0)).alias("cost_usd"))
            .orderBy("identifier", F.desc("cost_usd"), "model"))


def merge_usage_cost(usage: DataFrame, cost: DataFrame) -> DataFrame:
    """Calls and cost per identifier, with a by-model map of the costs."""
    calls = usage.groupBy("identifier").agg(F.sum("calls").alias("calls"))
    # Models per identifier: at most the number of model names, so the map stays small.
    money = cost.groupBy("identifier").agg(
        F.sum("cost_usd").alias("cost_usd"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "cost_usd")))).alias("cost_by_model"))
    return (calls.join(money, "identifier", "left")
            .withColumn("cost_per_call", F.col("cost_usd") / F.col("calls")).orderBy(F.desc("calls"), "identifier"))


def with_share(df: DataFrame, column: str = "calls") -> DataFrame:
    """Percent of the whole; the total is a scalar subquery, not a join."""
    total = df.agg(F.sum(column)).scalar()
    return df.withColumn("share_percent", F.when(total > 0, F.col(column) * 100.0 / total).otherwise(0.0))
