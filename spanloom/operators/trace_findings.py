"""Findings about how the work in a trace went, over every trace at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig
from spanloom.functions import expr as E
from spanloom.functions.skew import carry_last, percentiles_of, running_total, runs
from spanloom.operators.span_tree import attributed_calls, call_numbers, priced_calls
from spanloom.operators.traces import first_prompt_by_trace
from spanloom.operators.tuning import SHELL_REPLACEMENTS

# Tool groups and thresholds of the findings.
MUTATING = ("Edit", "Write", "NotebookEdit", "MultiEdit")
SEARCHING = ("Read", "Grep", "Glob")
CHAIN_CALLS = 15
WAIT_MS, LONG_WAIT_MS, WAIT_SHARE, ONE_PAUSE_SHARE = 10_000, 30_000, 0.25, 0.80
OUTLIER_CALLS, OUTLIER_MS, OUTLIER_MULTIPLE, OUTLIER_RATE = 3, 15_000, 2.5, 2.0
CACHE_CALLS, CACHE_SHARE = 3, 0.70
START_TOKENS, PEAK_TOKENS, GROWTH = 200_000, 300_000, 2.0
SUBAGENT_SHARE, CALL_SHARE, CALL_MIN = 0.4, 0.25, 4
NAME_LENGTH = 5

_ORDER = ["start_timestamp", "call_no"]


def _tool_calls(calls: DataFrame, cfg: TelemetryConfig) -> DataFrame:
    return calls.where(F.col("name") == cfg.tool_span)


def _tool() -> Column:
    return F.coalesce("tool_name", F.lit("unknown"))


def _ms() -> Column:
    return F.floor(F.col("duration_nanos") / 1e6).cast("long")


def _revisits(calls: DataFrame, cfg: TelemetryConfig) -> DataFrame:
    files = _tool_calls(calls, cfg).where("file_path IS NOT NULL").withColumn("tool", _tool())
    edit = F.col("tool").isin(*MUTATING).cast("long")
    counted = running_total(files, ["trace_id", "file_path"], _ORDER, edit, "edits")
    return (counted.withColumn("generation", F.col("edits") - edit)
            .groupBy("trace_id", "branch", "tool", "file_path", "generation")
            .agg(E.row_count().alias("visits"), F.min("call_no").alias("first_call"), F.max("call_no").alias("last_call")).where("visits >= 2"))


def revisited_files(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """The same call on the same file twice or more with no edit of it in between."""
    return _revisits(attributed_calls(spans, cfg), cfg)


def shell_antipatterns(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    calls = call_numbers(spans, cfg).where((F.col("name") == cfg.tool_span) & F.col("full_command").isNotNull())
    token = F.split(F.trim("full_command"), r"\s+", 2)[0]
    replacement = F.create_map(*[F.lit(x) for kv in SHELL_REPLACEMENTS.items() for x in kv])[F.col("command")]
    return (calls.withColumn("command", token).withColumn("replacement", replacement).where("replacement IS NOT NULL")
            .groupBy("trace_id", "command", "replacement").agg(E.row_count().alias("calls"), F.min("call_no").alias("first_call")))


def _results(logs: DataFrame, cfg: TelemetryConfig) -> DataFrame:
    """The last recorded result of each tool call; failed unless it says true."""
    rows = logs.where((F.col("event_name") == cfg.tool_result) & F.col("tool_use_id").isNotNull())
    last = rows.groupBy("trace_id", "tool_use_id").agg(
        F.max_by(F.struct("success", F.col("attributes")["error"].alias("error")), F.struct("timestamp", "id")).alias("r"))
    return last.select("trace_id", "tool_use_id", (F.lower("r.success") != "true").alias("failed"), F.col("r.error").alias("error"))


def failed_tool_calls(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    calls = _tool_calls(call_numbers(spans, cfg), cfg)
    message = F.trim(F.regexp_replace("error", r"\s+", " "))
    return (calls.join(_results(logs, cfg).where("failed"), ["trace_id", "tool_use_id"])
            .select("trace_id", "span_id", "call_no", _tool().alias("tool"), message.alias("message")))


def _model_failure() -> Column:
    a = F.col("attributes")
    return a["error"].isNotNull() | F.coalesce(F.col("status_code") == "error", F.lit(False))


def failed_model_calls(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    a = F.col("attributes")
    calls = call_numbers(spans, cfg).where((F.col("name") == cfg.llm_span) & _model_failure())
    code = E.number(F.trim(a["status_code"]), "int")
    rows = calls.select("trace_id", "call_no", code.alias("http_status"),
                        F.coalesce(a["error"], F.col("status_message"), F.lit("unknown")).alias("message"))
    environment = F.coalesce(F.col("http_status").isin(408, 429) | (F.col("http_status") >= 500), F.lit(False))
    return (rows.groupBy("trace_id", "http_status", "message").agg(E.row_count().alias("calls"), F.min("call_no").alias("first_call"))
            .withColumn("environmental", environment))


def blocked_on_user(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Traces that waited long for approvals, unless one pause explains nearly all of it."""
    waits = (spans.where((F.col("name") == cfg.blocked_span) & F.col("parent_span_id").isNotNull())
             .groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum(_ms()).alias("blocked_ms")))
    numbered = _tool_calls(call_numbers(spans, cfg), cfg).select("trace_id", "span_id", "call_no").join(waits, ["trace_id", "span_id"])
    longest = F.max(F.struct("blocked_ms", (-F.col("call_no")).alias("n")))
    per = numbered.groupBy("trace_id").agg(
        F.sum("blocked_ms").alias("total_blocked_ms"), F.count_if(F.col("blocked_ms") >= WAIT_MS).alias("long_waits"), longest.alias("m"))
    lengths = spans.groupBy("trace_id").agg(
        F.floor((F.unix_micros(F.max("end_timestamp")) - F.unix_micros(F.min("start_timestamp"))) / 1000).alias("trace_ms"))
    share = F.col("total_blocked_ms") / F.col("trace_ms")
    return (per.join(lengths, "trace_id").where("long_waits > 0 AND trace_ms > 0").withColumn("blocked_share", share)
            .withColumn("longest_ms", F.col("m.blocked_ms")).withColumn("longest_call", -F.col("m.n"))
            .where((F.col("blocked_share") >= WAIT_SHARE) | (F.col("longest_ms") >= LONG_WAIT_MS))
            .where(F.col("longest_ms") / F.col("total_blocked_ms") < ONE_PAUSE_SHARE)
            .select("trace_id", "total_blocked_ms", "blocked_share", "long_waits", "longest_ms", "longest_call"))


def model_call_outlier(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """A model call far slower than the trace's median, unless it was busy writing."""
    tokens = F.coalesce(E.number(F.col("attributes")["output_tokens"], "long"), F.lit(0))
    calls = (call_numbers(spans, cfg).where(F.col("name") == cfg.llm_span)
             .select("trace_id", "call_no", "model", _ms().alias("ms"), tokens.alias("out")))
    slowest = F.max_by(F.struct("call_no", "model", "ms", "out"), F.struct("ms", -F.col("call_no")))
    per = calls.groupBy("trace_id").agg(E.row_count().alias("model_calls"), slowest.alias("s"))
    per = per.where((F.col("model_calls") >= OUTLIER_CALLS) & (F.col("s.ms") >= OUTLIER_MS))
    rate = F.when(F.col("out") > 0, F.col("ms") / F.col("out"))
    medians = percentiles_of(calls, ["trace_id"], {"median_ms": (F.col("ms"), 0.5), "median_rate": (rate, 0.5)}, kind="disc")
    writing = F.coalesce((F.col("s.out") > 0) & (F.col("median_rate") > 0)
                         & (F.col("s.ms") / F.col("s.out") < F.col("median_rate") * OUTLIER_RATE), F.lit(False))
    return (per.join(medians, "trace_id")
            .where((F.col("median_ms") > 0) & (F.col("s.ms") >= F.col("median_ms") * OUTLIER_MULTIPLE) & ~writing)
            .select("trace_id", F.col("s.call_no").alias("call_no"), F.col("s.model").alias("model"), F.col("s.ms").alias("duration_ms"),
                    F.col("s.out").alias("output_tokens"), F.col("median_ms").cast("long").alias("median_ms"), "model_calls"))


def _prompt_tokens() -> Column:
    a = F.col("attributes")
    return sum((F.coalesce(E.number(a[k], "long"), F.lit(0)) for k in ("input_tokens", "cache_creation_tokens", "cache_read_tokens")), F.lit(0))


def poor_cache_reuse(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    read = F.coalesce(E.number(F.col("attributes")["cache_read_tokens"], "long"), F.lit(0))
    per = spans.where(F.col("name") == cfg.llm_span).groupBy("trace_id").agg(
        E.row_count().alias("model_calls"), F.sum(read).alias("cache_read_tokens"), F.sum(_prompt_tokens()).alias("prompt_tokens"))
    return (per.where((F.col("model_calls") >= CACHE_CALLS) & (F.col("prompt_tokens") > 0))
            .withColumn("cache_share", F.col("cache_read_tokens") / F.col("prompt_tokens")).where(F.col("cache_share") < CACHE_SHARE))


def context_growth(spans: DataFrame, logs: DataFrame, start_tokens: int = START_TOKENS, peak_tokens: int = PEAK_TOKENS,
                   cfg: TelemetryConfig = CFG) -> DataFrame:
    """Main loops that began on a large context or whose context grew steeply."""
    main = priced_calls(spans, logs, cfg).where("is_model AND unit = 'main'").withColumn("tokens", _prompt_tokens())
    per = main.groupBy("trace_id").agg(F.min_by("tokens", "call_no").alias("start_tokens"), F.max("tokens").alias("peak_tokens"),
                                       E.row_count().alias("main_loop_calls"))
    loaded = F.col("start_tokens") >= start_tokens
    grew = (F.col("peak_tokens") >= peak_tokens) & (F.col("peak_tokens") >= F.col("start_tokens") * GROWTH)
    return per.withColumn("started_loaded", loaded).withColumn("grew_steeply", grew).where("started_loaded OR grew_steeply")


def cost_concentration(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Subagents or single calls that carry a large share of a trace's measured cost."""
    calls = priced_calls(spans, logs, cfg).where("is_model")
    # Sums per branch first: the trace totals come from these few rows, not from all calls again.
    per = calls.groupBy("trace_id", "dispatch_no").agg(
        F.sum("cost_usd").alias("usd"), E.row_count().alias("calls"), F.max(F.struct("cost_usd", (-F.col("call_no")).alias("n"))).alias("top"))
    whole = (per.groupBy("trace_id").agg(F.sum("usd").alias("measured_usd"), F.sum("calls").alias("model_calls"), F.max("top").alias("top"))
             .where("measured_usd > 0"))
    subagents = (per.where("dispatch_no IS NOT NULL").join(whole.select("trace_id", "measured_usd"), "trace_id")
                 .select("trace_id", F.lit("subagent").alias("kind"), F.col("dispatch_no").alias("call_no"), F.col("usd").alias("cost_usd"),
                         (F.col("usd") / F.col("measured_usd")).alias("share")).where(F.col("share") >= SUBAGENT_SHARE))
    single = (whole.where(F.col("model_calls") >= CALL_MIN)
              .select("trace_id", F.lit("call").alias("kind"), (-F.col("top.n")).alias("call_no"), F.col("top.cost_usd").alias("cost_usd"),
                      (F.col("top.cost_usd") / F.col("measured_usd")).alias("share")).where(F.col("share") >= CALL_SHARE))
    return subagents.unionByName(single)


def adjacent_repeats(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Consecutive equal calls as one row, with the first earlier run of the same content."""
    calls = attributed_calls(spans, cfg)
    content = F.concat_ws(" ", "branch", F.when(F.col("name") == cfg.llm_span, F.concat_ws(" ", F.lit("llm_request"), "model"))
                          .otherwise(F.concat_ws(" ", _tool(), F.coalesce("file_path", "full_command"))))
    numbered = runs(calls.withColumn("content", content), ["trace_id"], _ORDER, ["content"], "run")
    groups = numbered.groupBy("trace_id", "run", "content").agg(F.min("call_no").alias("first_call"), E.row_count().alias("repeat_count"))
    firsts = groups.groupBy("trace_id", "content").agg(F.min("first_call").alias("seen_at"))
    return (groups.join(firsts, ["trace_id", "content"])
            .select("trace_id", "content", "first_call", "repeat_count", F.when(F.col("seen_at") < F.col("first_call"), F.col("seen_at")).alias("repeat_of")))


def focused_resolution(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Traces in which every edit followed a look at the file, nothing failed, nothing was revisited."""
    calls = attributed_calls(spans, cfg).withColumn("tool", _tool())
    is_tool = F.col("name") == cfg.tool_span
    results = _results(logs, cfg).select("trace_id", "tool_use_id", "failed")
    bad = (calls.join(results, ["trace_id", "tool_use_id"], "left")
           .where((is_tool & F.coalesce("failed", F.lit(False))) | (~is_tool & _model_failure())).select("trace_id"))
    files = calls.where(is_tool & F.col("file_path").isNotNull())
    searched = carry_last(files, ["trace_id", "branch", "file_path"], _ORDER,
                          F.when(F.col("tool").isin(*SEARCHING), F.col("call_no")), "search_no")
    edits = searched.where(F.col("tool").isin(*MUTATING))
    near = F.coalesce(F.col("call_no") - F.col("search_no") <= CHAIN_CALLS, F.lit(False))
    good = edits.groupBy("trace_id").agg(F.min(near).alias("all_near"), E.row_count().alias("edits")).where("all_near")
    return (good.join(bad, "trace_id", "left_anti").join(_revisits(calls, cfg).select("trace_id"), "trace_id", "left_anti")
            .select("trace_id", "edits"))


def read_only_resolution(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Traces without edits whose first tool call named a file and succeeded."""
    calls = attributed_calls(spans, cfg)
    tools = _tool_calls(calls, cfg).withColumn("tool", _tool())
    per = (tools.groupBy("trace_id").agg(F.max(F.col("tool").isin(*MUTATING)).alias("edited"),
                                         F.min_by(F.struct("file_path", "tool_use_id", "call_no"), "call_no").alias("f"))
           .where(~F.col("edited") & F.col("f.file_path").isNotNull())
           .select("trace_id", F.col("f.file_path").alias("file_path"), F.col("f.tool_use_id").alias("tool_use_id"), F.col("f.call_no").alias("first_call")))
    failed = _results(logs, cfg).where("failed").select("trace_id", "tool_use_id")
    return (per.join(failed, ["trace_id", "tool_use_id"], "left_anti").join(_revisits(calls, cfg).select("trace_id"), "trace_id", "left_anti")
            .select("trace_id", "file_path", "first_call"))


def compaction_runs(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    a = F.col("attributes")
    failed = F.coalesce(F.lower(F.col("success")) != "true", F.lit(False))
    return logs.where(F.col("event_name") == cfg.compaction).select(
        "trace_id", "id", "timestamp", a["trigger"].alias("trigger"), failed.alias("failed"), E.number(a["pre_tokens"], "long").alias("pre_tokens"),
        E.number(a["post_tokens"], "long").alias("post_tokens"), E.rounded_long("duration_ms").alias("duration_ms"),
        F.when(failed, a["error"]).alias("error"))


def skill_activations(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    a = F.col("attributes")
    rows = logs.where((F.col("event_name") == cfg.skill_activated) & (F.trim("skill_name") != ""))
    first = F.min_by(F.struct(a["skill.source"].alias("source"), a["invocation_trigger"].alias("trigger")), F.struct("timestamp", "id"))
    return (rows.groupBy("trace_id", "skill_name").agg(first.alias("f"), F.min("timestamp").alias("activated_at"))
            .select("trace_id", "skill_name", "activated_at", "f.source", "f.trigger",
                    F.coalesce(F.col("f.source") == "projectSettings", F.lit(False)).alias("editable")))


def error_lines(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Equal error messages of a trace with their counts, from spans and tool results."""
    failed = spans.where((F.col("status_code") == "error") & F.col("status_message").isNotNull() & (F.col("name") != cfg.tool_execution_span))
    a = F.col("attributes")
    told = logs.where((F.col("event_name") == cfg.tool_result) & a["error"].isNotNull())
    source = F.when(F.col("name") == cfg.llm_span, "llm_request").otherwise(F.coalesce("tool_name", "name"))
    both = failed.select("trace_id", source.alias("source"), F.col("status_message").alias("message")).unionByName(
        told.select("trace_id", _tool().alias("source"), a["error"].alias("message")))
    return both.groupBy("trace_id", "source", "message").agg(E.row_count().alias("occurrences"))


def directed_start(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Traces whose first tool call went to a file the prompt names."""
    first = (_tool_calls(call_numbers(spans, cfg), cfg).groupBy("trace_id")
             .agg(F.min_by(F.struct(_tool().alias("tool"), F.coalesce("file_path", "full_command").alias("target"), "call_no"), "call_no").alias("f")))
    named = first.select("trace_id", F.col("f.tool").alias("tool"), F.col("f.call_no").alias("call_no"),
                         F.substring_index("f.target", "/", -1).alias("file_name"))
    prompts = first_prompt_by_trace(logs, 2**31 - 1, cfg=cfg)
    return (named.where(F.length("file_name") >= NAME_LENGTH).join(prompts, "trace_id")
            .where(F.contains(F.lower("first_user_prompt"), F.lower("file_name"))).select("trace_id", "tool", "file_name", "call_no"))
