"""The generic ``events`` table seen as agent telemetry (mapping in FIXTURES.md)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import CFG
from spanloom.functions.skew import running_total
from spanloom.schema import enrich_logs, enrich_points, enrich_spans
from spanloom.sources.deltas import counter_deltas


def _attributes(pairs: dict[str, str]):
    """A map of the pairs whose value is not NULL."""
    entries = ", ".join(f"struct('{k}' AS key, CAST({v} AS STRING) AS value)" for k, v in pairs.items())
    return F.expr(f"map_from_entries(filter(array({entries}), e -> e.value IS NOT NULL))")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id"), F.col("event_type"), F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.concat(F.lit("s"), F.col("user_id")).alias("sid"),
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 20).cast("string")).alias("tr"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("sp"),
        F.when(F.col("user_id") % 3 != 2, F.concat(F.lit("repo"), F.col("user_id") % 3)).alias("repo"))


def _spread(events: DataFrame) -> DataFrame:
    """Events dealt over tasks by their columns: a file with few row groups would be mapped by as few tasks."""
    return events.repartition("id", "timestamp", "user_id")


def event_logs(events: DataFrame) -> DataFrame:
    named = _spread(events).withColumn("ev", F.expr("""
        CASE event_type WHEN 'purchase' THEN 'api_request' WHEN 'signup' THEN 'user_prompt'
             WHEN 'click' THEN 'tool_result' WHEN 'view' THEN 'tool_result'
             ELSE CASE WHEN k % 2 = 0 THEN 'tool_result' ELSE 'tool_decision' END END""")
    ).withColumn("tn", F.expr("""
        CASE event_type WHEN 'click' THEN 'Edit' WHEN 'error' THEN CASE k % 8 WHEN 4 THEN 'Edit' WHEN 6 THEN 'Read' ELSE 'Bash' END
             WHEN 'view' THEN CASE k % 5 WHEN 0 THEN 'Agent' WHEN 1 THEN 'mcp_tool' ELSE 'Read' END END"""))
    request, result, decision = "ev = 'api_request'", "ev = 'tool_result'", "ev = 'tool_decision'"
    attributes = _attributes({
        "event.name": "ev",
        "session.id": "sid",
        "prompt.id": "concat('p', user_id, '-', date_format(timestamp, 'yyyy-MM-dd'))",
        "tool_name": "tn",
        "tool_input": """CASE WHEN tn IN ('Edit', 'Read') THEN concat('{"file_path":"/f/', k % 7, '.py"}')
                              WHEN tn = 'Bash' THEN concat('{"command":"cd /w && grep x', k % 4, '"}')
                              WHEN tn = 'Agent' THEN CASE WHEN k % 2 = 0 THEN '{"subagent_type":"Explore"}' ELSE '{}' END END""",
        "tool_parameters": """CASE WHEN tn = 'mcp_tool' THEN
            concat('{"mcp_server_name":"srv', k % 3, '","mcp_tool_name":"op', k % 2, '"}') END""",
        "success": f"CASE WHEN {result} THEN CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END END",
        "decision": f"CASE WHEN {decision} THEN CASE WHEN k % 3 = 0 THEN 'reject' ELSE 'accept' END END",
        "source": f"CASE WHEN {decision} THEN 'user' END",
        "duration_ms": f"CASE WHEN {result} OR {request} THEN k * 100 END",
        "tool_result_size_bytes": f"CASE WHEN {result} AND k % 10 <> 9 THEN CAST(round(v * 1000) AS BIGINT) END",
        "tool_use_id": "CASE WHEN tn IS NOT NULL THEN concat('c', id) END",
        "request_id": f"CASE WHEN {request} THEN concat('r', id) END",
        "model": f"CASE WHEN {request} THEN concat('m', k % 3) END",
        "effort": f"CASE WHEN {request} THEN CASE k % 4 WHEN 1 THEN 'low' WHEN 2 THEN 'high' END END",
        "query_source": f"""CASE WHEN {request} THEN CASE WHEN k % 5 = 0 THEN 'agent:Explore'
                            WHEN k % 5 = 4 THEN 'compact' ELSE 'repl_main_thread' END END""",
        "skill.name": f"CASE WHEN {request} AND k % 10 = 3 THEN concat('sk', k % 2) END",
        "agent.name": f"CASE WHEN {request} AND k % 5 = 0 THEN 'Explore' END",
        "cost_usd": f"CASE WHEN {request} THEN CAST(CAST(v AS DECIMAL(12,2)) * 0.01 AS DECIMAL(14,4)) END",
        "input_tokens": f"CASE WHEN {request} THEN k END",
        "output_tokens": f"CASE WHEN {request} THEN k * 2 END",
        "cache_creation_tokens": f"CASE WHEN {request} THEN k * 3 END",
        "cache_read_tokens": f"CASE WHEN {request} THEN k * 10 END",
        "prompt": "CASE WHEN ev = 'user_prompt' THEN concat('do  task ', k) END",
        "error": """CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'command not found'
                    WHEN 1 THEN 'timed out' WHEN 2 THEN 'old_string' ELSE 'boom' END END""",
        "vcs.repository.url.full": "repo",
    })
    return named.select(
        "id", "timestamp", F.col("timestamp").alias("observed_timestamp"), F.col("timestamp").alias("received_at"),
        F.lit(None).cast("int").alias("severity_number"), F.lit(None).cast("string").alias("severity_text"),
        F.col("ev").alias("body"), F.lit("events").alias("scope_name"),
        F.col("tr").alias("trace_id"), F.col("sp").alias("span_id"), attributes.alias("attributes"),
        F.expr("map()").cast("map<string,string>").alias("resource_attributes"),
        F.expr("map()").cast("map<string,string>").alias("scope_attributes"),
        F.expr("array()").cast("array<string>").alias("nested_attribute_keys"))


def event_points(events: DataFrame) -> DataFrame:
    """Cumulative counters. Running sums use decimals, so they cannot fall by rounding."""
    day_block = F.floor(F.unix_micros("timestamp") / F.lit(864_000_000_000)).cast("long")
    money = F.col("v").cast("decimal(18,2)")
    base = events.withColumn("mdl", F.concat(F.lit("m"), F.col("k") % 3))

    def shaped(df: DataFrame, ordinal: int, name: str, unit: str, attributes, double=None, long=None) -> DataFrame:
        return df.select(
            (F.col("id") + 10_000_000 * ordinal).alias("id"), F.lit(name).alias("metric_name"), F.lit(unit).alias("unit"),
            F.lit("").alias("description"), F.lit("events").alias("scope_name"), "timestamp",
            F.lit(None).cast("timestamp").alias("start_timestamp"), F.col("timestamp").alias("received_at"),
            (F.lit(None) if double is None else double).cast("double").alias("value_double"),
            (F.lit(None) if long is None else long).cast("long").alias("value_long"),
            F.lit("double" if long is None else "long").alias("value_kind"), attributes.alias("attributes"),
            F.expr("map()").cast("map<string,string>").alias("resource_attributes"),
            F.expr("map()").cast("map<string,string>").alias("scope_attributes"))

    buys = base.where("event_type = 'purchase'")
    cost = running_total(buys.withColumn("block", day_block), ["sid", "mdl", "repo", "block"], ["timestamp", "id"], money, "run")
    kinds = buys.withColumn("tt", F.expr(
        "CASE k % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'output' WHEN 2 THEN 'cacheCreation' ELSE 'cacheRead' END"))
    tokens = running_total(kinds, ["sid", "mdl", "tt", "repo"], ["timestamp", "id"],
                           F.round(F.col("v") * 10).cast("long"), "run")
    busy = base.where("event_type IN ('click', 'view')")
    active = running_total(busy, ["sid", "repo"], ["timestamp", "id"],
                           F.when(F.col("event_type") == "click", money).otherwise(F.lit(0).cast("decimal(18,2)")), "run")
    common = {"session.id": "sid", "vcs.repository.url.full": "repo"}
    return (
        shaped(cost, 1, CFG.cost_metric, "USD", _attributes({**common, "model": "mdl"}), double=F.col("run"))
        .unionByName(shaped(tokens, 2, CFG.token_metric, "tokens",
                            _attributes({**common, "model": "mdl", "type": "tt"}), long=F.col("run")))
        .unionByName(shaped(active, 3, CFG.active_metric, "s", _attributes(common), double=F.col("run")))
        .unionByName(shaped(base.where("event_type = 'signup'"), 4, CFG.session_metric, "count", _attributes({
            **common, "start_type": "CASE WHEN k % 2 = 0 THEN 'fresh' ELSE 'resume' END",
            "terminal.type": "CASE WHEN k % 3 = 0 THEN 'interactive' END"}), long=F.lit(1))))


def event_spans(events: DataFrame) -> DataFrame:
    shaped = _spread(events).withColumn("j", F.col("id") % 20).withColumn("tn", F.expr("""
        CASE event_type WHEN 'click' THEN 'Edit' WHEN 'error' THEN CASE k % 8 WHEN 4 THEN 'Edit' WHEN 6 THEN 'Read' ELSE 'Bash' END
             WHEN 'view' THEN CASE k % 5 WHEN 0 THEN 'Agent' WHEN 1 THEN 'mcp_tool' ELSE 'Read' END END"""))
    buy = "event_type = 'purchase'"
    attributes = _attributes({
        "session.id": "sid",
        "tool_name": "tn",
        "tool_use_id": "CASE WHEN tn IS NOT NULL THEN concat('c', id) END",
        "file_path": "CASE WHEN tn IN ('Edit', 'Read') THEN concat('/f/', k % 7, '.py') END",
        "full_command": "CASE WHEN tn = 'Bash' THEN concat('cd /w && grep x', k % 4) END",
        "request_id": f"CASE WHEN {buy} THEN concat('r', id) END",
        "model": f"CASE WHEN {buy} THEN concat('m', k % 3) END",
        "input_tokens": f"CASE WHEN {buy} THEN k END",
        "output_tokens": f"CASE WHEN {buy} THEN k * 2 END",
        "cache_creation_tokens": f"CASE WHEN {buy} THEN k * 3 END",
        "cache_read_tokens": f"CASE WHEN {buy} THEN k * 10 END",
        "vcs.repository.url.full": "repo",
    })
    length = F.round(F.col("v") * 1_000_000).cast("long")
    return shaped.select(
        "id", F.col("tr").alias("trace_id"), F.col("sp").alias("span_id"),
        F.when(F.col("j") > 0, F.concat(F.lit("e"), F.expr("CAST((id - j) + (j - 1) DIV 2 AS STRING)"))).alias("parent_span_id"),
        F.expr("""CASE WHEN j = 0 THEN 'claude_code.interaction' WHEN event_type = 'purchase' THEN 'claude_code.llm_request'
                  WHEN event_type = 'signup' THEN 'claude_code.tool.execution' ELSE 'claude_code.tool' END""").alias("name"),
        F.lit("internal").alias("kind"), F.col("timestamp").alias("start_timestamp"),
        F.timestamp_micros(F.unix_micros("timestamp") + length).alias("end_timestamp"),
        F.col("timestamp").alias("received_at"), (length * 1000).alias("duration_nanos"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status_code"),
        F.lit(None).cast("string").alias("status_message"), F.lit(CFG.span_scope).alias("scope_name"),
        attributes.alias("attributes"), F.expr("map()").cast("map<string,string>").alias("resource_attributes"),
        F.expr("map()").cast("map<string,string>").alias("scope_attributes"),
        F.lit(None).cast("array<struct<name:string,timestamp:timestamp,attributes:map<string,string>>>").alias("events"))


@dataclass(frozen=True)
class Telemetry:
    """The three enriched tables, derived lazily from one event table."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def events(self) -> DataFrame:
        return read_events(self.spark, self.sf_dir)

    @cached_property
    def logs(self) -> DataFrame:
        return enrich_logs(event_logs(self.events))

    @cached_property
    def points(self) -> DataFrame:
        return counter_deltas(enrich_points(event_points(self.events)))

    @cached_property
    def spans(self) -> DataFrame:
        return enrich_spans(event_spans(self.events))
