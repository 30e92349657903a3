"""Turns: a prompt and what happened until the next one, for all sessions in one job."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig
from spanloom.functions import expr as E
from spanloom.functions.skew import carry_last, cut_lineage, row_numbers, top_value
from spanloom.operators.log_explorer import dispatching_traces
from spanloom.operators.sessions import root_spans

_TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
_KINDS = dict(zip(_TOKENS, CFG.token_types))


def _of(df: DataFrame, session: str | None) -> DataFrame:
    return df.where(F.col("session_id").isNotNull() if session is None else F.col("session_id") == session)


def prompts(logs: DataFrame, session: str | None = None, limit: int | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = _of(logs, session).where(F.col("event_name") == cfg.user_prompt).select(
        "session_id", F.col("timestamp").alias("turn_ts"), "id", F.col("prompt").alias("prompt_text"),
        E.real_trace_id("trace_id").alias("trace_id"), "prompt_id")
    return rows if limit is None else rows.orderBy("turn_ts", "id").limit(limit)


def turns(logs: DataFrame, session: str | None = None) -> DataFrame:
    return row_numbers(prompts(logs, session), ["session_id"], ["turn_ts", "id"], "turn_no")


def _requests(logs: DataFrame, session: str | None, cfg: TelemetryConfig) -> DataFrame:
    return _of(logs, session).where(F.col("event_name") == cfg.api_request)


def _sum_tokens() -> list[Column]:
    return [F.coalesce(E.rounded_long(F.sum(c)), F.lit(0)).alias(c) for c in _TOKENS]


def request_turns(logs: DataFrame, session: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = _requests(logs, session, cfg).where(F.col("prompt_id").isNotNull())
    keys = ["session_id", "prompt_id"]
    sums = rows.groupBy(*keys).agg(
        E.row_count().alias("request_count"), *_sum_tokens(), F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.coalesce(E.rounded_long(F.sum("duration_ms")), F.lit(0)).alias("duration_ms"))
    return sums.join(top_value(rows, keys, "model", "model"), keys, "left")


def session_requests(logs: DataFrame, session: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    return _requests(logs, session, cfg).select(
        "session_id", "request_id", F.col("timestamp").alias("request_timestamp"), "id", "prompt_id", "model",
        *[F.coalesce(E.rounded_long(c), F.lit(0)).alias(c) for c in _TOKENS], F.col("cost_usd").cast("double").alias("cost_usd"),
        E.rounded_long("duration_ms").alias("duration_ms"), "effort", "speed", E.real_trace_id("trace_id").alias("trace_id"))


def cost_points_of(points: DataFrame, session: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = _of(points, session).where((F.col("metric_name") == cfg.cost_metric) & F.col("value_double").isNotNull())
    return rows.select("session_id", "timestamp", "id", "value_delta")


def token_points_of(points: DataFrame, session: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = _of(points, session).where((F.col("metric_name") == cfg.token_metric) & F.col("model").isNotNull())
    return rows.select("session_id", "timestamp", "id", "model", "token_type", "value_delta")


def tool_events(logs: DataFrame, session: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = _of(logs, session).where((F.col("event_name") == cfg.tool_result) & F.col("tool_name").isNotNull())
    return rows.select("session_id", "timestamp", "id", "tool_name")


def assign_turn(events: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """Give each event the last turn that began at or before it; earlier events are dropped."""
    tagged = events.withColumn("__turn", F.lit(None).cast("long")).withColumn("__after", F.lit(1))
    marks = turn_rows.select("session_id", F.col("turn_ts").alias("timestamp"), F.col("turn_no").alias("__turn"), "id",
                             F.lit(0).alias("__after"))
    line = tagged.unionByName(marks, allowMissingColumns=True)
    # At one instant a turn begins before its events, and a later turn replaces an earlier one.
    found = carry_last(line, ["session_id"], ["timestamp", "__after", "id"], F.col("__turn"), "turn_no")
    return found.where((F.col("__after") == 1) & F.col("turn_no").isNotNull()).drop("__turn", "__after")


def root_ends(spans: DataFrame) -> DataFrame:
    return root_spans(spans).groupBy("trace_id").agg(F.max("end_timestamp").alias("root_end"))


def _late() -> Column:
    return F.coalesce(F.col("timestamp") > F.col("root_end"), F.lit(False))


def cost_split_by_trace(logs: DataFrame, spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.api_request) & F.col("cost_usd").isNotNull() & F.col("trace_id").isNotNull())
    return (rows.select("trace_id", "timestamp", "cost_usd").join(root_ends(spans), "trace_id", "left").groupBy("trace_id").agg(
        F.sum("cost_usd").cast("double").alias("total_cost_usd"),
        F.coalesce(F.sum(F.when(_late(), F.col("cost_usd"))).cast("double"), F.lit(0.0)).alias("background_cost_usd")))


def tool_split_by_trace(logs: DataFrame, spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.tool_result) & F.col("tool_name").isNotNull() & F.col("trace_id").isNotNull())
    return (rows.select("trace_id", "timestamp", "tool_name").join(root_ends(spans), "trace_id", "left")
            .groupBy("trace_id", "tool_name")
            .agg(F.count_if(~_late()).alias("own_count"), F.count_if(_late()).alias("background_count")))


def token_split_by_trace(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.api_request) & F.col("trace_id").isNotNull())
    return rows.groupBy("trace_id").agg(*_sum_tokens())


def model_by_trace(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.api_request) & F.col("trace_id").isNotNull())
    return top_value(rows, ["trace_id"], "model", "model")


def dispatched_turns(turn_rows: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Turns opened by a task notification, with the trace that launched the task (never their own)."""
    notified = (turn_rows.withColumn("tool_use_id", E.notification_tool_use_id("prompt_text")).where("tool_use_id IS NOT NULL")
                .select("session_id", "turn_no", "tool_use_id", "turn_ts", F.col("trace_id").alias("own_trace")))
    newest = notified.groupBy("session_id").agg(F.max("turn_ts").alias("before_ts"))
    asked = notified.select("session_id", "tool_use_id").distinct().join(newest, "session_id")
    found = dispatching_traces(logs, asked, cfg).withColumnRenamed("trace_id", "dispatching_trace_id")
    return (notified.join(found, ["session_id", "tool_use_id"])
            .where(F.col("dispatching_trace_id").isNotNull() & ~F.col("dispatching_trace_id").eqNullSafe(F.col("own_trace")))
            .select("session_id", "turn_no", "dispatching_trace_id"))


def prompt_tools(turn_rows: DataFrame, logs: DataFrame, spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Tool counts per turn: the trace's own where the turn is the first of its trace, else by interval."""
    first = first_turn_of_trace(turn_rows)
    by_trace = (first.join(tool_split_by_trace(logs, spans, cfg), "trace_id")
                .select("session_id", "turn_no", "tool_name", (F.col("own_count") + F.col("background_count")).alias("calls"),
                        F.col("background_count").alias("background_calls")))
    by_time = (assign_turn(tool_events(logs, cfg=cfg), turn_rows).groupBy("session_id", "turn_no", "tool_name")
               .agg(E.row_count().alias("calls")).withColumn("background_calls", F.lit(0).cast("long"))
               .join(first.select("session_id", "turn_no"), ["session_id", "turn_no"], "left_anti"))
    return by_trace.unionByName(by_time)


def first_turn_of_trace(turn_rows: DataFrame) -> DataFrame:
    return (turn_rows.where("trace_id IS NOT NULL").groupBy("session_id", "trace_id").agg(F.min("turn_no").alias("turn_no")))


def prompt_timeline(logs: DataFrame, points: DataFrame, spans: DataFrame, session: str | None = None,
                    cfg: TelemetryConfig = CFG) -> DataFrame:
    """Cost, tokens, model and attribution of every turn.

    A trace is billed whole to its first turn. A turn without one takes its
    requests by prompt id, or else the counters of its interval.
    """
    keys = ["session_id", "turn_no"]
    # One row per prompt, read by every part below.
    t = cut_lineage(turns(logs, session))
    c = F.col
    both = cost_points_of(points, session, cfg).unionByName(token_points_of(points, session, cfg), allowMissingColumns=True)
    # Only token points carry a model here, so it tells the two kinds apart.
    timed = assign_turn(both, t).withColumn("is_token", c("model").isNotNull())
    per_model = timed.groupBy(*keys, "model").agg(
        F.sum(F.when(~c("is_token"), c("value_delta"))).alias("usd"), F.sum(F.when(c("is_token"), c("value_delta"))).alias("n"),
        *[E.rounded_long(F.coalesce(F.sum(F.when(c("token_type") == kind, c("value_delta"))), F.lit(0))).alias(name) for name, kind in _KINDS.items()])
    counted = per_model.groupBy(*keys).agg(
        F.sum("usd").alias("interval_cost"), F.max_by("model", F.when(c("model").isNotNull(), F.struct("n", "model"))).alias("interval_model"),
        *[F.sum(F.when(c("model").isNotNull(), c(name))).alias(f"interval_{name}") for name in _KINDS])
    rollup = request_turns(logs, session, cfg)
    rollup = rollup.select("session_id", "prompt_id", "request_count", *[F.col(c).alias(f"request_{c}") for c in _TOKENS],
                           F.col("cost_usd").alias("request_cost"), F.col("model").alias("request_model"))
    split = cost_split_by_trace(logs, spans, cfg)
    traced_tokens = token_split_by_trace(logs, cfg).select("trace_id", *[F.col(c).alias(f"trace_{c}") for c in _TOKENS])
    traced_model = model_by_trace(logs, cfg).withColumnRenamed("model", "trace_model")
    traced = first_turn_of_trace(t).select("trace_id", *keys)
    traced = (traced.join(split, "trace_id", "left").join(traced_tokens, "trace_id", "left").join(traced_model, "trace_id", "left")
              .withColumn("is_first", F.lit(True)).drop("trace_id"))
    billed = split.select("trace_id", F.lit(True).alias("billed"))
    out = t.join(billed, "trace_id", "left")
    for side in (counted, traced, dispatched_turns(t, logs, cfg)):
        out = out.join(side, keys, "left")
    out = out.join(rollup, ["session_id", "prompt_id"], "left")
    by_request = c("request_count").isNotNull()
    first = F.coalesce(c("is_first"), F.lit(False))
    # A later turn of a trace already billed keeps no interval cost of its own.
    kept = F.when(~first & c("billed"), F.lit(None)).otherwise(c("interval_cost"))
    cost = F.coalesce(c("total_cost_usd"), kept)
    return out.select(
        *keys, "turn_ts", "trace_id", "prompt_id", F.when(by_request, "REQUEST").otherwise("INTERVAL").alias("attribution"),
        F.coalesce("request_count", F.lit(0)).alias("request_count"),
        F.coalesce(c("trace_model"), F.when(by_request, c("request_model")).otherwise(c("interval_model"))).alias("model"),
        F.when(by_request, F.coalesce(cost, c("request_cost"))).otherwise(cost).alias("cost_usd"),
        F.when(c("background_cost_usd") > 0, c("background_cost_usd")).alias("background_cost_usd"),
        *[F.coalesce(c(f"trace_{n}"), F.when(by_request, c(f"request_{n}")).otherwise(c(f"interval_{n}"))).alias(n) for n in _TOKENS],
        "dispatching_trace_id")


def nest_turns(turn_rows: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Depth and pre-order key of turns, a dispatched turn under the first turn of its dispatching trace.

    ``turn_rows`` holds session_id, turn_no, trace_id, dispatching_trace_id. Parents
    are found by joins; chains are then halved round by round.
    """
    first = first_turn_of_trace(turn_rows).withColumnsRenamed({"trace_id": "dispatching_trace_id", "turn_no": "parent_no"})
    linked = turn_rows.join(first, ["session_id", "dispatching_trace_id"], "left")
    own = F.col("dispatching_trace_id").eqNullSafe(F.col("trace_id"))
    parent = F.when(~own & (F.col("parent_no") < F.col("turn_no")), F.col("parent_no"))
    state = cut_lineage(linked.select("session_id", "turn_no", parent.alias("parent_no"), parent.alias("jump"),
                                      F.array("turn_no").alias("path")))
    for _ in range(max_rounds):
        if state.where("jump IS NOT NULL").limit(1).count() == 0:
            break
        up = state.select("session_id", F.col("turn_no").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("above"))
        state = cut_lineage(state.join(up, ["session_id", "jump"], "left").select(
            "session_id", "turn_no", "parent_no", F.col("next").alias("jump"),
            F.concat(F.coalesce("above", F.array().cast("array<bigint>")), "path").alias("path")))
    return state.select("session_id", "turn_no", "parent_no", (F.size("path") - 1).alias("depth"), "path")


