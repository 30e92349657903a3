"""The span forest of every trace: depth, pre-order, ancestors, and what is read off them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig
from spanloom.functions import expr as E
from spanloom.functions.skew import CHUNK_SECONDS, cut_lineage, row_numbers

WATERFALL_ROWS, WATERFALL_DEPTH = 40, 1
RELATED = 3
UNNAMED = "subagent"


def span_paths(spans: DataFrame, carry: Mapping[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Path from the root to each span, found for all traces at once.

    Every span starts with a pointer to its parent; each round joins the pointers
    to themselves, which doubles their reach, so depth d takes about log2(d) rounds.
    A span whose parent is missing is a root. Spans on a parent cycle hang from no
    root and are left out. A span delivered again counts once, as it came last.
    ``carry`` adds columns to each path element.
    """
    step = F.struct(F.col("start_timestamp").alias("start"), F.col("span_id"), *[c.alias(n) for n, c in (carry or {}).items()])
    columns = ["parent_span_id", *keep, "path"]
    nodes = (spans.select("trace_id", "span_id", "parent_span_id", *keep, F.array(step).alias("path"), F.struct("received_at", "id").alias("__newest"))
             .groupBy("trace_id", "span_id", F.when(F.col("span_id").isNull(), F.col("__newest")["id"]).alias("__nameless"))
             .agg(F.max_by(F.struct(*columns), "__newest").alias("__row")).select("trace_id", "span_id", *[F.col("__row")[c].alias(c) for c in columns]))
    known = nodes.where("span_id IS NOT NULL").select("trace_id", F.col("span_id").alias("jump"), F.lit(True).alias("known"))
    start = nodes.withColumn("jump", F.col("parent_span_id")).join(known, ["trace_id", "jump"], "left")
    state = start.withColumn("jump", F.when(F.col("known"), F.col("jump"))).drop("known")
    state = cut_lineage(state)
    open_before = None
    while True:
        open_now = state.where("jump IS NOT NULL").count()
        if open_now == 0 or open_now == open_before:
            break
        open_before = open_now
        done = state.where("jump IS NULL")
        pending = state.where("jump IS NOT NULL")
        up = state.select("trace_id", F.col("span_id").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("above"))
        moved = (pending.join(up, ["trace_id", "jump"]).withColumn("path", F.concat("above", "path"))
                 .withColumn("jump", F.col("next")).drop("next", "above"))
        state = cut_lineage(done.unionByName(moved))
    return state.where("jump IS NULL").drop("jump").withColumn("depth", (F.size("path") - 1).cast("long"))


def _path_chunk() -> Column:
    """Pieces of a trace in pre-order: its roots, then minutes of each root's children."""
    child = F.when(F.size("path") > 1, F.floor(F.unix_micros(F.try_element_at("path", F.lit(2))["start"]) / (CHUNK_SECONDS * 1_000_000)))
    root = F.col("path")[0]
    return F.struct(F.unix_micros(root["start"]).alias("t"), root["span_id"].alias("s"), F.coalesce(child, F.lit(-1)).alias("c"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Depth and 1-based pre-order index; siblings in order of start."""
    paths = span_paths(spans)
    numbered = row_numbers(paths, ["trace_id"], ["path"], "preorder", chunk=_path_chunk())
    return numbered.select("trace_id", "span_id", "parent_span_id", "depth", "preorder", F.transform("path", lambda e: e["span_id"]).alias("ancestry"))


def is_call(cfg: TelemetryConfig = CFG) -> Column:
    return F.col("name").isin(cfg.tool_span, cfg.llm_span)


def call_numbers(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Tool calls and model calls of each trace, numbered by start."""
    return row_numbers(spans.where(is_call(cfg)), ["trace_id"], ["start_timestamp", "span_id"], "call_no")


def attributed_calls(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Numbered calls with the dispatches around them, outermost first."""
    numbers = call_numbers(spans, cfg).select("trace_id", "span_id", "call_no")
    dispatch = F.when((F.col("name") == cfg.tool_span) & (F.col("tool_name") == cfg.subagent_tool), F.col("call_no"))
    kept = ("name", "tool_name", "tool_use_id", "request_id", "model", "file_path", "full_command", "start_timestamp",
            "duration_nanos", "status_code", "status_message", "attributes", "call_no")
    numbered = spans.join(numbers, ["trace_id", "span_id"], "left")
    paths = span_paths(numbered, {"dispatch": dispatch}, keep=kept)
    above = F.slice("path", 1, F.size("path") - 1)
    chain = F.transform(F.filter(above, lambda e: e["dispatch"].isNotNull()), lambda e: e["dispatch"])
    return (paths.where(F.col("call_no").isNotNull()).withColumn("chain", chain)
            .withColumn("dispatch_no", F.try_element_at("chain", F.lit(-1)))
            .withColumn("branch", F.when(F.size("chain") > 0, F.array_join(F.col("chain").cast("array<string>"), ">")).otherwise("main"))
            .drop("path", "depth"))


def dispatch_chain(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    return attributed_calls(spans, cfg).select("trace_id", "span_id", "call_no", "branch", "dispatch_no")


def _requests(logs: DataFrame, cfg: TelemetryConfig) -> DataFrame:
    """One row per request id; a later record replaces an earlier one."""
    rows = logs.where((F.col("event_name") == cfg.api_request) & F.col("request_id").isNotNull())
    return (rows.groupBy("request_id").agg(F.max_by(F.struct("cost_usd", "query_source"), F.struct("timestamp", "id")).alias("q"))
            .select("request_id", F.coalesce(F.col("q.cost_usd"), F.lit(0).cast(E.MONEY)).alias("cost_usd"),
                    F.col("q.query_source").alias("query_source"), F.lit(True).alias("requested")))


def priced_calls(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Attributed calls with their request's cost and the unit that bears it."""
    calls = attributed_calls(spans, cfg).join(_requests(logs, cfg), "request_id", "left")
    source = F.col("query_source")
    auxiliary = source.isNotNull() & ~source.isin(*cfg.main_loop_sources) & ~source.startswith(cfg.subagent_source_prefix)
    unit = (F.when(F.col("dispatch_no").isNotNull(), "subagent").when(auxiliary, "auxiliary").otherwise("main"))
    is_model = F.col("name") == cfg.llm_span
    return (calls.withColumn("is_model", is_model).withColumn("unit", unit)
            .withColumn("cost_usd", F.when(is_model, F.coalesce(F.col("cost_usd").cast("double"), F.lit(0.0))).otherwise(0.0)))


def _agent_label(cfg: TelemetryConfig) -> Column:
    kind = F.regexp_replace(F.expr(f"substring(query_source, {len(cfg.subagent_source_prefix) + 1})"), "^builtin:", "")
    return F.when(F.col("query_source").startswith(cfg.subagent_source_prefix) & (F.trim(kind) != ""), kind)


def trace_cost_breakdown(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Cost and calls of the main loop, each dispatched subagent, and auxiliary requests, per trace.

    Tool calls count only inside a subagent. A dispatch without calls still has a row.
    """
    calls = priced_calls(spans, logs, cfg)
    counted = calls.where(F.col("is_model") | F.col("dispatch_no").isNotNull())
    label = _agent_label(cfg)
    sums = counted.groupBy("trace_id", "unit", "dispatch_no").agg(
        F.sum("cost_usd").alias("cost_usd"), F.count_if("is_model").alias("model_calls"), F.count_if(~F.col("is_model")).alias("tool_calls"),
        F.min_by(label, F.when(F.col("is_model") & label.isNotNull(), F.col("call_no"))).alias("label"))
    dispatches = (calls.where((F.col("name") == cfg.tool_span) & (F.col("tool_name") == cfg.subagent_tool))
                  .select("trace_id", F.lit("subagent").alias("unit"), F.col("call_no").alias("dispatch_no")))
    subagents = dispatches.join(sums, ["trace_id", "unit", "dispatch_no"], "left").withColumn("label", F.coalesce("label", F.lit(UNNAMED)))
    rest = sums.where("unit <> 'subagent'").withColumn("label", F.lit(None).cast("string"))
    zero = {"cost_usd": 0.0, "model_calls": 0, "tool_calls": 0}
    return rest.unionByName(subagents.select(*rest.columns)).na.fill(zero)


def trace_cost_totals(spans: DataFrame, logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Measured cost per trace and its costliest call (the first of equals)."""
    calls = priced_calls(spans, logs, cfg).where("is_model")
    best = F.max(F.struct("cost_usd", (-F.col("call_no")).alias("n")))
    return (calls.groupBy("trace_id").agg(F.sum("cost_usd").alias("measured_usd"), E.row_count().alias("model_calls"), best.alias("b"))
            .select("trace_id", "measured_usd", "model_calls", F.when(F.col("b.cost_usd") > 0, -F.col("b.n")).alias("costliest_call"),
                    F.col("b.cost_usd").alias("costliest_usd")))


def time_attribution(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    ms = F.floor(F.col("duration_nanos") / 1e6)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("name") == name, ms)), F.lit(0)).cast("long")

    out = spans.groupBy("trace_id").agg(
        total(cfg.llm_span).alias("llm_ms"), total(cfg.tool_execution_span).alias("tool_ms"), total(cfg.blocked_span).alias("blocked_ms"),
        F.floor((F.unix_micros(F.max("end_timestamp")) - F.unix_micros(F.min("start_timestamp"))) / 1000).cast("long").alias("trace_ms"))
    return out.withColumns({f"{n}_percent": F.when(F.col("trace_ms") > 0, F.col(f"{n}_ms") * 100.0 / F.col("trace_ms")).otherwise(0.0)
                            for n in ("llm", "tool", "blocked")})


def work_tools(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = spans.where(F.col("name") == cfg.tool_span)
    return rows.groupBy("trace_id", F.coalesce("tool_name", F.lit("unknown")).alias("tool")).agg(E.row_count().alias("calls"))


def work_models(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = spans.where((F.col("name") == cfg.llm_span) & (F.trim("model") != ""))
    return rows.groupBy("trace_id", "model").agg(E.row_count().alias("calls"))


def work_files(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = spans.where((F.col("name") == cfg.tool_span) & (F.trim("file_path") != ""))
    return (rows.groupBy("trace_id", "file_path", F.coalesce("tool_name", F.lit("unknown")).alias("tool"))
            .agg(E.row_count().alias("calls"), F.min("start_timestamp").alias("first_at")))


def descendant_errors(spans: DataFrame) -> DataFrame:
    """Failed spans below each span; an error is counted once at each of its ancestors."""
    paths = span_paths(spans, keep=("status_code",))
    above = F.transform(F.slice("path", 1, F.size("path") - 1), lambda e: e["span_id"])
    counts = (paths.where("status_code = 'error'").select("trace_id", F.explode(above).alias("span_id"))
              .groupBy("trace_id", "span_id").agg(E.row_count().alias("descendant_errors")))
    return (spans.select("trace_id", "span_id").join(counts, ["trace_id", "span_id"], "left")
            .withColumn("descendant_errors", F.coalesce("descendant_errors", F.lit(0))))


def waterfall(spans: DataFrame, max_rows: int = WATERFALL_ROWS, max_depth: int = WATERFALL_DEPTH) -> DataFrame:
    """The top of each trace as bars: offsets in percent of the shown rows' time span."""
    paths = span_paths(spans, keep=("start_timestamp", "duration_nanos", "status_code"))
    all_rows = row_numbers(paths, ["trace_id"], ["path"], "preorder", chunk=_path_chunk())
    shown = row_numbers(all_rows.where(F.col("depth") <= max_depth), ["trace_id"], ["path"], "position", chunk=_path_chunk())
    shown = shown.where(F.col("position") <= max_rows)
    start = F.unix_micros("start_timestamp") / 1000.0
    ms = F.coalesce(F.col("duration_nanos") / 1e6, F.lit(0.0))
    frame = shown.groupBy("trace_id").agg(F.min(start).alias("t0"), F.max(start + ms).alias("t1"))
    total = F.greatest(F.col("t1") - F.col("t0"), F.lit(1.0))
    left = F.greatest((start - F.col("t0")) / total * 100.0, F.lit(0.0))
    right = F.least((start - F.col("t0") + ms) / total * 100.0, F.lit(100.0))
    return (shown.join(frame, "trace_id").join(descendant_errors(spans), ["trace_id", "span_id"])
            .select("trace_id", "span_id", "depth", "preorder", "descendant_errors", left.alias("left_percent"), right.alias("right_percent"),
                    F.greatest(right - left, F.lit(0.0)).alias("width_percent")))


def same_file_relations(spans: DataFrame, n: int = RELATED, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Up to ``n`` earlier and later tool calls on the same file, with the distance in tool calls.

    Calls are numbered in the trace and within the file, and neighbours are met by
    joining on the number, so no file's calls come together in one task.
    """
    tools = spans.where((F.col("name") == cfg.tool_span) & F.col("tool_name").isNotNull())
    numbered = row_numbers(tools, ["trace_id"], ["start_timestamp", "span_id"], "tool_no")
    filed = row_numbers(numbered.where("file_path <> ''"), ["trace_id", "file_path"], ["start_timestamp", "span_id"], "file_no")
    base = filed.select("trace_id", "file_path", "span_id", "tool_no", "file_no")
    offsets = F.array(*[F.lit(d) for d in range(-n, n + 1) if d])
    asked = base.withColumn("offset", F.explode(offsets)).withColumn("other_no", F.col("file_no") + F.col("offset"))
    other = base.select("trace_id", "file_path", F.col("file_no").alias("other_no"), F.col("span_id").alias("related_span_id"), F.col("tool_no").alias("related_no"))
    return asked.join(other, ["trace_id", "file_path", "other_no"]).select(
        "trace_id", "span_id", "file_path", F.when(F.col("offset") < 0, "earlier").otherwise("later").alias("direction"),
        F.abs("offset").alias("rank"), "related_span_id", F.abs(F.col("related_no") - F.col("tool_no")).alias("calls_away"))


def span_token_breakdown(spans: DataFrame) -> DataFrame:
    parts = {f"{k}_tokens": E.token_part("attributes", k).cast("long") for k in E.TOKEN_ALIASES}
    return (spans.select("trace_id", "span_id", *[c.alias(n) for n, c in parts.items()])
            .withColumn("total_tokens", sum((F.col(n) for n in parts), F.lit(0))).where("total_tokens > 0"))


def label_subtree_by_dispatch(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Label of the nearest dispatch at or above each span; spans outside any are left out."""
    kind = F.coalesce(E.blank_to_null(F.col("attributes")["subagent_type"]), F.lit("Subagent"))
    label = F.when(F.col("tool_name") == cfg.subagent_tool, kind)
    paths = span_paths(spans, {"label": label})
    found = F.try_element_at(F.filter("path", lambda e: e["label"].isNotNull()), F.lit(-1))
    return paths.select("trace_id", "span_id", found["label"].alias("label"), found["span_id"].alias("dispatch_span_id")).where("label IS NOT NULL")
