"""Registry of checkable queries, and the tables their SQL twins start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.config import TimeRange, utc
from spanloom.sources.tables import StoredTelemetry, stored

# The test tables span January 2024; both ranges cover every row.
W = TimeRange(utc("2024-01-01"), utc("2024-01-31"))
CP = TimeRange(utc("2024-01-16"), utc("2024-01-31"))
DAY = 86400

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Plain column types, so that two engines can be compared value by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, build: Callable[[StoredTelemetry], DataFrame], sql: str | None = None, plain: bool = False) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: comparable(build(stored(spark, sf_dir)))
    if sql:
        ORACLES[name] = sql if plain else with_tables(sql)


EV = r"""
ev AS MATERIALIZED (
  SELECT event_id AS id, ts, user_id, event_type, value AS v,
         CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k,
         's' || user_id AS sid, 't' || (event_id // 20) AS tr, 'e' || event_id AS sp,
         CASE WHEN user_id % 3 <> 2 THEN 'repo' || (user_id % 3) END AS repo
  FROM events)"""

LOGS = r"""
logs0 AS (
  SELECT *, CASE event_type WHEN 'purchase' THEN 'api_request' WHEN 'signup' THEN 'user_prompt'
                 WHEN 'click' THEN 'tool_result' WHEN 'view' THEN 'tool_result'
                 ELSE CASE WHEN k % 2 = 0 THEN 'tool_result' ELSE 'tool_decision' END END AS en,
         CASE event_type WHEN 'click' THEN 'Edit' WHEN 'error' THEN CASE k % 8 WHEN 4 THEN 'Edit' WHEN 6 THEN 'Read' ELSE 'Bash' END
              WHEN 'view' THEN CASE k % 5 WHEN 0 THEN 'Agent' WHEN 1 THEN 'mcp_tool' ELSE 'Read' END END AS tn
  FROM ev),
logs AS MATERIALIZED (
  SELECT id, ts, sid, tr, sp, repo, en, tn, k, event_type,
    'p' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS pid,
    CASE WHEN tn IN ('Edit', 'Read') THEN '/f/' || (k % 7) || '.py' END AS file_path,
    CASE WHEN tn = 'Bash' THEN 'cd /w && grep x' || (k % 4) END AS command,
    CASE WHEN tn = 'Agent' AND k % 2 = 0 THEN 'Explore' WHEN tn = 'Agent' THEN 'general-purpose' END AS subagent,
    CASE WHEN tn = 'mcp_tool' THEN 'srv' || (k % 3) END AS server,
    CASE WHEN tn = 'mcp_tool' THEN 'op' || (k % 2) END AS mcp_op,
    CASE WHEN tn = 'mcp_tool' THEN 'mcp:srv' || (k % 3) ELSE coalesce(tn, 'unknown') END AS tool,
    CASE WHEN tn = 'mcp_tool' THEN 'op' || (k % 2) WHEN tn IN ('Edit', 'Read') THEN '/f/' || (k % 7) || '.py'
         WHEN tn = 'Bash' THEN 'grep x' || (k % 4) ELSE '' END AS scope,
    CASE WHEN en = 'tool_result' THEN CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END END AS success,
    CASE WHEN en = 'tool_decision' THEN CASE WHEN k % 3 = 0 THEN 'reject' ELSE 'accept' END END AS decision,
    CASE WHEN en IN ('tool_result', 'api_request') THEN CAST(k * 100 AS DOUBLE) END AS ms,
    CASE WHEN en = 'tool_result' AND k % 10 <> 9 THEN CAST(round(v * 1000) AS BIGINT) END AS bytes,
    CASE WHEN tn IS NOT NULL THEN 'c' || id END AS tuid,
    CASE WHEN en = 'api_request' THEN 'r' || id END AS rid,
    CASE WHEN en = 'api_request' THEN 'm' || (k % 3) END AS model,
    CASE WHEN en = 'api_request' THEN CASE k % 4 WHEN 1 THEN 'low' WHEN 2 THEN 'high' END END AS effort,
    CASE WHEN en = 'api_request' THEN CASE WHEN k % 5 = 0 THEN 'agent:Explore' WHEN k % 5 = 4 THEN 'compact'
         ELSE 'repl_main_thread' END END AS qs,
    CASE WHEN en = 'api_request' AND k % 10 = 3 THEN 'sk' || (k % 2) END AS skill,
    CASE WHEN en = 'api_request' AND k % 5 = 0 THEN 'Explore' END AS agent,
    CASE WHEN en = 'api_request' THEN CAST(CAST(v AS DECIMAL(12,2)) * 0.01 AS DECIMAL(14,4)) END AS cost,
    CASE WHEN en = 'api_request' THEN k END AS ti, CASE WHEN en = 'api_request' THEN k * 2 END AS tou,
    CASE WHEN en = 'api_request' THEN k * 3 END AS tcc, CASE WHEN en = 'api_request' THEN k * 10 END AS tcr,
    CASE WHEN en = 'user_prompt' THEN 'do  task ' || k END AS prompt,
    CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'command not found' WHEN 1 THEN 'timed out'
         WHEN 2 THEN 'old_string' ELSE 'boom' END END AS error,
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS sev,
    CASE WHEN en <> 'api_request' THEN NULL WHEN k % 5 = 0 THEN 'SUBAGENT' WHEN k % 10 = 3 THEN 'SKILL'
         WHEN k % 5 <> 4 THEN 'MAIN_LOOP' ELSE 'AUXILIARY' END AS category
  FROM logs0)"""

POINTS = r"""
raw_points AS (
  SELECT id + 10000000 AS id, ts, sid, repo, 'claude_code.cost.usage' AS metric, 'USD' AS unit, 'm' || (k % 3) AS model,
    CAST(NULL AS VARCHAR) AS tt, CAST(NULL AS VARCHAR) AS start_type, CAST(NULL AS VARCHAR) AS terminal, TRUE AS is_double,
    CAST(sum(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY sid, k % 3, epoch_us(ts) // 864000000000
         ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cur
  FROM ev WHERE event_type = 'purchase'
  UNION ALL
  SELECT id + 20000000, ts, sid, repo, 'claude_code.token.usage', 'tokens', 'm' || (k % 3),
    CASE k % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'output' WHEN 2 THEN 'cacheCreation' ELSE 'cacheRead' END, NULL, NULL, FALSE,
    CAST(sum(CAST(round(v * 10) AS BIGINT)) OVER (PARTITION BY sid, k % 3, k % 4 ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  FROM ev WHERE event_type = 'purchase'
  UNION ALL
  SELECT id + 30000000, ts, sid, repo, 'claude_code.active_time.total', 's', NULL, NULL, NULL, NULL, TRUE,
    CAST(sum(CASE WHEN event_type = 'click' THEN CAST(v AS DECIMAL(18,2)) ELSE 0 END)
         OVER (PARTITION BY sid ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  FROM ev WHERE event_type IN ('click', 'view')
  UNION ALL
  SELECT id + 40000000, ts, sid, repo, 'claude_code.session.count', 'count', NULL, NULL,
    CASE WHEN k % 2 = 0 THEN 'fresh' ELSE 'resume' END, CASE WHEN k % 3 = 0 THEN 'interactive' END, FALSE, 1.0
  FROM ev WHERE event_type = 'signup'),
points AS MATERIALIZED (
  SELECT * EXCLUDE (prev), CASE WHEN cur >= coalesce(prev, 0) THEN cur - coalesce(prev, 0) ELSE cur END AS d
  FROM (SELECT *, concat_ws('|', metric, sid, coalesce(model, '-'), coalesce(tt, '-'), coalesce(start_type, '-'),
                            coalesce(terminal, '-')) AS stream,
               lag(cur) OVER (PARTITION BY metric, sid, model, tt, start_type, terminal ORDER BY ts, id) AS prev
        FROM raw_points)),
moving AS (SELECT * FROM points WHERE d <> 0)"""

SPANS = r"""
spans0 AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'Edit' WHEN 'error' THEN CASE k % 8 WHEN 4 THEN 'Edit' WHEN 6 THEN 'Read' ELSE 'Bash' END
         WHEN 'view' THEN CASE k % 5 WHEN 0 THEN 'Agent' WHEN 1 THEN 'mcp_tool' ELSE 'Read' END END AS tn FROM ev),
spans AS MATERIALIZED (
  SELECT id, tr, sp, sid, repo, k, event_type, v, id % 20 AS j,
    CASE WHEN id % 20 > 0 THEN 'e' || ((id - id % 20) + (id % 20 - 1) // 2) END AS parent,
    CASE WHEN id % 20 = 0 THEN 'claude_code.interaction' WHEN event_type = 'purchase' THEN 'claude_code.llm_request'
         WHEN event_type = 'signup' THEN 'claude_code.tool.execution' ELSE 'claude_code.tool' END AS name,
    ts AS st, ts + to_microseconds(CAST(round(v * 1000000) AS BIGINT)) AS et,
    CAST(round(v * 1000000) AS BIGINT) * 1000 AS nanos,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    tn,
    CASE WHEN event_type IN ('click', 'error', 'view') THEN 'c' || id END AS tuid,
    CASE WHEN event_type = 'purchase' THEN 'r' || id END AS rid,
    CASE WHEN event_type = 'purchase' THEN 'm' || (k % 3) END AS model,
    CASE WHEN event_type = 'purchase' THEN k ELSE 0 END AS ti, CASE WHEN event_type = 'purchase' THEN 2 * k ELSE 0 END AS tou,
    CASE WHEN event_type = 'purchase' THEN 3 * k ELSE 0 END AS tcc, CASE WHEN event_type = 'purchase' THEN 10 * k ELSE 0 END AS tcr,
    CASE WHEN tn IN ('Edit', 'Read') THEN '/f/' || (k % 7) || '.py' END AS file_path,
    CASE WHEN tn = 'Bash' THEN 'cd /w && grep x' || (k % 4) END AS command
  FROM spans0)"""


def with_tables(sql: str) -> str:
    """Put the table definitions a query names in front of it."""
    import re

    parts = [EV]
    for name, text in (("logs", LOGS), ("points|moving", POINTS), ("spans", SPANS)):
        if re.search(rf"\b(FROM|JOIN)\s+({name})\b", sql):
            parts.append(text)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        body = body[5:].lstrip()
        recursive = body[:10].upper() == "RECURSIVE "
        body = body[10:] if recursive else body
        return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)},\n{body}"
    return f"WITH {','.join(parts)}\n{body}"
