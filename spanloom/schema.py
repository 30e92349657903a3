"""Table shapes and the columns derived once, at write time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.config import CFG, TelemetryConfig
from spanloom.functions import expr as E

_MAP = T.MapType(T.StringType(), T.StringType(), True)


def _fields(**kinds) -> list[T.StructField]:
    return [T.StructField(name, kind, True) for name, kind in kinds.items()]


_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

LOG_SCHEMA = T.StructType(_fields(
    id=_L, timestamp=_TS, observed_timestamp=_TS, received_at=_TS, severity_number=_I, severity_text=_S,
    body=_S, scope_name=_S, trace_id=_S, span_id=_S, attributes=_MAP, resource_attributes=_MAP,
    scope_attributes=_MAP, nested_attribute_keys=T.ArrayType(_S)))

POINT_SCHEMA = T.StructType(_fields(
    id=_L, metric_name=_S, unit=_S, description=_S, scope_name=_S, timestamp=_TS, start_timestamp=_TS,
    received_at=_TS, value_double=_D, value_long=_L, value_kind=_S, attributes=_MAP,
    resource_attributes=_MAP, scope_attributes=_MAP))

SPAN_EVENT = T.StructType(_fields(name=_S, timestamp=_TS, attributes=_MAP))

SPAN_SCHEMA = T.StructType(_fields(
    id=_L, trace_id=_S, span_id=_S, parent_span_id=_S, name=_S, kind=_S, start_timestamp=_TS,
    end_timestamp=_TS, received_at=_TS, duration_nanos=_L, status_code=_S, status_message=_S, scope_name=_S,
    attributes=_MAP, resource_attributes=_MAP, scope_attributes=_MAP, events=T.ArrayType(SPAN_EVENT)))


def _repository(cfg: TelemetryConfig):
    return F.coalesce(F.col("attributes")[cfg.repository_key], F.col("resource_attributes")[cfg.repository_key])


def _utc_date(ts: Column | str) -> Column:
    """The UTC day, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def enrich_logs(logs: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Promote the keys queries filter, group and sum on, so scans skip the wide map."""
    a = F.col("attributes")
    promoted = {
        "derived_severity": E.derive_severity(a, "severity_text", "severity_number"),
        "event_name": a["event.name"],
        "tool_name": a["tool_name"],
        "session_id": a["session.id"],
        "repository_url": _repository(cfg),
        "event_date": _utc_date("timestamp"),
        "prompt_id": a["prompt.id"],
        "request_id": a["request_id"],
        "tool_use_id": a["tool_use_id"],
        "model": a["model"],
        "effort": a["effort"],
        "speed": a["speed"],
        "query_source": a["query_source"],
        "skill_name": a["skill.name"],
        "has_skill": F.coalesce(F.map_contains_key(a, F.lit("skill.name")), F.lit(False)),
        "agent_name": a["agent.name"],
        "has_agent": F.coalesce(F.map_contains_key(a, F.lit("agent.name")), F.lit(False)),
        "success": a["success"],
        "decision": a["decision"],
        "cost_usd": E.number(a["cost_usd"], E.MONEY),
        "input_tokens": E.number(a["input_tokens"]),
        "output_tokens": E.number(a["output_tokens"]),
        "cache_creation_tokens": E.number(a["cache_creation_tokens"]),
        "cache_read_tokens": E.number(a["cache_read_tokens"]),
        "duration_ms": E.number(a["duration_ms"]),
        "result_bytes": E.number(a["tool_result_size_bytes"]),
        "tool": E.mcp_aware_tool(a, cfg),
        "scope": E.tool_scope(a, cfg),
        "file_path": E.json_text(a["tool_input"], "file_path"),
        "command": E.json_text(a["tool_input"], "command"),
        "prompt": a["prompt"],
    }
    return logs.withColumns({k: v for k, v in promoted.items() if k not in logs.columns})


def enrich_points(points: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    a = F.col("attributes")
    promoted = {
        "stream_id": F.md5(F.concat("metric_name", F.lit("|"), F.coalesce(E.canonical_attributes(a), F.lit("")))),
        "session_id": a["session.id"],
        "repository_url": _repository(cfg),
        "event_date": _utc_date("timestamp"),
        "model": a["model"],
        "token_type": a["type"],
        "decision": a["decision"],
    }
    return points.withColumns({k: v for k, v in promoted.items() if k not in points.columns})


def enrich_spans(spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    a = F.col("attributes")
    promoted = {
        "session_id": a["session.id"],
        "repository_url": _repository(cfg),
        "event_date": _utc_date("start_timestamp"),
        "tool_name": a["tool_name"],
        "tool_use_id": a["tool_use_id"],
        "request_id": a["request_id"],
        "model": a["model"],
        "file_path": a["file_path"],
        "full_command": a["full_command"],
        "total_tokens": E.span_token_total(a).cast("double"),
    }
    return spans.withColumns({k: v for k, v in promoted.items() if k not in spans.columns})
