"""Checkable queries: log exploration and tool activity."""

from spanloom.catalog.base import CP, DAY, W, query
from spanloom.config import utc
from spanloom.operators import log_explorer as L
from spanloom.operators import tools as A

ALL = L.LogFilter(W)
CUR = (utc("2024-01-15T12:00:00"), 5000)

query("log_histogram", lambda t: L.log_histogram(t.logs, L.LogFilter(W, severities=("ERROR",), text="task"), DAY), """
    WITH axis AS (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS b FROM range(31) r(i))
    SELECT epoch_us(a.b) AS bucket, count(*) FILTER (l.sev = 'ERROR') AS error_count, count(*) FILTER (l.sev = 'WARN') AS warn_count,
           count(*) FILTER (l.sev = 'INFO') AS info_count, count(*) FILTER (l.sev = 'DEBUG') AS debug_count
    FROM axis a LEFT JOIN (SELECT * FROM logs WHERE prompt ILIKE '%task%') l ON date_trunc('day', l.ts) = a.b GROUP BY a.b""")

query("log_facet_severity", lambda t: L.log_facet_severity(t.logs, L.LogFilter(W, severities=("INFO",), tools=("Bash", "Read"))), """
    SELECT s.label AS derived_severity, count(l.id) AS row_count
    FROM (VALUES ('ERROR'), ('WARN'), ('INFO'), ('DEBUG')) s(label)
    LEFT JOIN (SELECT * FROM logs WHERE tn IN ('Bash', 'Read')) l ON l.sev = s.label GROUP BY s.label""")

query("log_facet_event", lambda t: L.log_facet_event(t.logs, L.LogFilter(W, events=("api_request",), pairs=("decision=reject",))), """
    SELECT en AS facet_value, count(*) AS row_count FROM logs WHERE decision = 'reject' GROUP BY en""")

query("log_facet_tool", lambda t: L.log_facet_tool(t.logs, L.LogFilter(W, tools=("Edit",), severities=("INFO", "ERROR"), repository="repo1")), """
    SELECT tn AS facet_value, count(*) AS row_count FROM logs
    WHERE tn IS NOT NULL AND repo = 'repo1' GROUP BY tn""")

query("log_count", lambda t: L.log_count(t.logs, L.LogFilter(W, severities=("ERROR",), text="OLD_string")), """
    SELECT count(*) AS row_count FROM logs WHERE sev = 'ERROR' AND error ILIKE '%OLD_string%'""")

_PAGE = "SELECT id, epoch_us(ts) AS timestamp, en AS event_name, tn AS tool_name, sev AS derived_severity FROM logs"


def _page(df):
    return df.select("id", "timestamp", "event_name", "tool_name", "derived_severity")


query("log_page_first", lambda t: _page(L.log_page_first(t.logs, L.LogFilter(W, events=("tool_result",)), 50)),
      _PAGE + " WHERE en = 'tool_result' ORDER BY ts DESC, id DESC LIMIT 51")
query("log_page_before", lambda t: _page(L.log_page_before(t.logs, ALL, CUR, 50)),
      _PAGE + " WHERE ts < TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC, id DESC LIMIT 51")
query("log_page_after", lambda t: _page(L.log_page_after(t.logs, ALL, CUR, 50)),
      _PAGE + " WHERE ts > TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC, id DESC LIMIT 51")
query("log_page_offset", lambda t: _page(L.log_page_offset(t.logs, L.LogFilter(W, tools=("Bash",)), 2, 100)),
      _PAGE + " WHERE tn = 'Bash' ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 200")

_PAIRS = """
    WITH attrs AS (
      SELECT unnest([
        {'k': 'event.name', 'v': en}, {'k': 'session.id', 'v': sid}, {'k': 'prompt.id', 'v': pid}, {'k': 'tool_name', 'v': tn},
        {'k': 'tool_input', 'v': CASE WHEN file_path IS NOT NULL THEN '{"file_path":"' || file_path || '"}'
           WHEN command IS NOT NULL THEN '{"command":"' || command || '"}' WHEN subagent = 'Explore' THEN '{"subagent_type":"Explore"}'
           WHEN subagent IS NOT NULL THEN '{}' END},
        {'k': 'tool_parameters', 'v': '{"mcp_server_name":"' || server || '","mcp_tool_name":"' || mcp_op || '"}'},
        {'k': 'success', 'v': success}, {'k': 'decision', 'v': decision},
        {'k': 'source', 'v': CASE WHEN decision IS NOT NULL THEN 'user' END},
        {'k': 'duration_ms', 'v': CAST(CAST(ms AS BIGINT) AS VARCHAR)}, {'k': 'tool_result_size_bytes', 'v': CAST(bytes AS VARCHAR)},
        {'k': 'tool_use_id', 'v': tuid}, {'k': 'request_id', 'v': rid}, {'k': 'model', 'v': model}, {'k': 'effort', 'v': effort},
        {'k': 'query_source', 'v': qs}, {'k': 'skill.name', 'v': skill}, {'k': 'agent.name', 'v': agent},
        {'k': 'cost_usd', 'v': CAST(cost AS VARCHAR)}, {'k': 'input_tokens', 'v': CAST(ti AS VARCHAR)},
        {'k': 'output_tokens', 'v': CAST(tou AS VARCHAR)}, {'k': 'cache_creation_tokens', 'v': CAST(tcc AS VARCHAR)},
        {'k': 'cache_read_tokens', 'v': CAST(tcr AS VARCHAR)}, {'k': 'prompt', 'v': prompt}, {'k': 'error', 'v': error},
        {'k': 'vcs.repository.url.full', 'v': repo}]) AS a
      FROM logs WHERE %s)
    SELECT DISTINCT %s FROM attrs WHERE a.v IS NOT NULL%s"""

query("attribute_pairs", lambda t: L.attribute_pairs(t.logs, ALL), _PAIRS % ("TRUE", "a.k || '=' || a.v AS pair", ""))
query("attribute_keys", lambda t: L.attribute_keys(t.logs, L.LogFilter(W, pairs=("event.name=tool_result", "success=false"))),
      _PAIRS % ("en = 'tool_result' AND success = 'false'", "a.k AS key", ""))
query("attribute_values", lambda t: L.attribute_values(t.logs, L.LogFilter(W, repository="repo0"), "tool_name"),
      _PAIRS % ("repo = 'repo0'", "a.v AS value", " AND a.k = 'tool_name'"))

query("dispatching_traces", lambda t: L.dispatching_traces(t.logs), """
    SELECT sid AS session_id, tuid AS tool_use_id, tr AS trace_id FROM logs WHERE en = 'tool_result' AND tuid IS NOT NULL""")
query("last_response_before", lambda t: L.last_response_before(
    t.logs, "s8", utc("2024-01-20"), "t0", cfg=_responses()).select("id", "trace_id"), """
    SELECT id, tr AS trace_id FROM logs WHERE en = 'user_prompt' AND sid = 's8' AND ts < TIMESTAMP '2024-01-20' AND tr <> 't0'
    ORDER BY ts DESC, id DESC LIMIT 1""")
query("tool_call_by_id", lambda t: L.tool_call_by_id(t.logs, "s46", utc("2024-01-20"), "c1").select("id", "tool", "scope"), """
    SELECT id, tool, scope FROM logs WHERE en = 'tool_result' AND sid = 's46' AND tuid = 'c1' AND ts < TIMESTAMP '2024-01-20'""")
query("logs_for_trace", lambda t: L.logs_for_trace(t.logs, "t7").select("id", "span_id", "event_name"), """
    SELECT id, sp AS span_id, en AS event_name FROM logs WHERE tr = 't7'""")
query("spans_for_trace", lambda t: L.spans_for_trace(t.spans, "t7").select("id", "span_id", "parent_span_id", "name"), """
    SELECT id, sp AS span_id, parent AS parent_span_id, name FROM spans WHERE tr = 't7'""")


def _responses():
    """The test data has no responses; prompts stand in for them."""
    from spanloom.config import TelemetryConfig

    return TelemetryConfig(assistant_response="user_prompt")


_T = "FROM logs WHERE en = 'tool_result'"

query("tool_calls", lambda t: A.tool_calls(t.logs, W), f"SELECT tool, count(*) AS calls {_T} GROUP BY tool")
query("tool_calls_timeseries", lambda t: A.tool_calls_timeseries(t.logs, W, DAY, top_n=3), f"""
    WITH c AS (SELECT date_trunc('day', ts) AS b, tool, count(*) AS n {_T} GROUP BY 1, 2),
    top AS (SELECT tool FROM c GROUP BY tool ORDER BY sum(n) DESC, tool LIMIT 3)
    SELECT epoch_us(b) AS bucket, CASE WHEN top.tool IS NULL THEN 'other' ELSE c.tool END AS tool, CAST(sum(n) AS BIGINT) AS calls
    FROM c LEFT JOIN top USING (tool) GROUP BY 1, 2""")
query("tool_performance", lambda t: A.tool_performance(t.logs, W), f"""
    SELECT tool, count(*) AS calls, round(avg(ms)) AS avg_ms, round_even(quantile_cont(ms, 0.95), 0) AS p95_ms,
           round(avg(bytes)) AS avg_out {_T} GROUP BY tool""")
query("tool_latency", lambda t: A.tool_latency(t.spans, W), """
    SELECT tn AS tool, count(*) AS calls, quantile_cont(CAST(nanos AS DOUBLE), 0.5) AS p50_nanos,
           quantile_cont(CAST(nanos AS DOUBLE), 0.95) AS p95_nanos
    FROM spans WHERE name = 'claude_code.tool' AND tn IS NOT NULL GROUP BY tn""")
_FOOT = """SELECT tool, count(*) AS calls, CAST(sum(bytes) AS BIGINT) AS total_bytes,
    CAST(round_even(quantile_cont(CAST(bytes AS DOUBLE), 0.95), 0) AS BIGINT) AS p95_bytes,
    CAST(sum(bytes) // 4 AS BIGINT) AS estimated_tokens FROM logs WHERE en = 'tool_result' AND bytes IS NOT NULL"""
query("context_footprint", lambda t: A.context_footprint(t.logs, W), _FOOT + " GROUP BY tool")
query("tunable_context_footprint", lambda t: A.tunable_context_footprint(t.logs, W), _FOOT + " AND tn <> 'Agent' GROUP BY tool")
query("failure_rates", lambda t: A.failure_rates(t.logs, W, "repo0"), f"""
    SELECT tool, count(*) AS calls, count(*) FILTER (success = 'false') AS failures {_T} AND repo = 'repo0' GROUP BY tool""")
query("failures_by_signature", lambda t: A.failures_by_signature(t.logs, W), f"""
    SELECT tool, 'unknown' AS error_type, CASE error WHEN 'command not found' THEN 'command-not-found' WHEN 'timed out' THEN 'timeout'
             WHEN 'old_string' THEN 'old-string-mismatch' ELSE 'other' END AS error_signature,
           min(coalesce(file_path, command, '')) AS example_scope, min(error) AS example_message, count(*) AS failures
    {_T} AND success = 'false' GROUP BY 1, 2, 3""")
query("denials", lambda t: A.denials(t.logs, W), """
    SELECT tool, 'user' AS source, count(*) AS denials FROM logs WHERE en = 'tool_decision' AND decision = 'reject' GROUP BY tool""")
query("hook_executions", lambda t: A.hook_executions(t.logs, W, cfg=_hooks()), """
    SELECT 'unknown' AS hook_event, 'unknown' AS hook_name, count(*) AS total, CAST(0 AS BIGINT) AS successes,
           CAST(0 AS BIGINT) AS blocking_errors, CAST(0 AS BIGINT) AS non_blocking_errors, CAST(0 AS BIGINT) AS cancelled
    FROM logs WHERE en = 'tool_decision'""")


def _hooks():
    """The test data has no hook events; decisions stand in for them, without counts."""
    from spanloom.config import TelemetryConfig

    return TelemetryConfig(hook_complete="tool_decision")


query("tool_repeats", lambda t: A.tool_repeats(t.logs, W), f"""
    WITH e AS (
      SELECT sid, tn, CASE WHEN tn IN ('Edit', 'Read') THEN file_path WHEN tn = 'Bash' THEN 'grep x' || (k % 4) ELSE '(no scope)' END AS sc,
             coalesce(bytes, 0) AS nb, ts, id {_T}),
    n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, id) - row_number() OVER (PARTITION BY sid, tn, sc ORDER BY ts, id) AS g FROM e),
    r AS (SELECT sid, tn, sc, g, count(*) AS len, sum(nb) AS nb FROM n WHERE sc <> '(no scope)' GROUP BY ALL),
    best AS (SELECT sid, tn, sc, len, nb FROM r QUALIFY row_number() OVER (PARTITION BY sid, tn, sc ORDER BY len DESC, nb DESC) = 1)
    SELECT tn AS tool, sc AS scope, max(len) AS max_run, count(*) AS sessions,
           CAST(round(CAST(sum(nb) AS DOUBLE) / 4) AS BIGINT) AS estimated_tokens_burned,
           CAST(round_even(quantile_cont(CAST(len AS DOUBLE), 0.5), 0) AS BIGINT) AS median_run
    FROM best WHERE len >= 2 GROUP BY tn, sc ORDER BY 5 DESC, 3 DESC, 6 DESC, 4 DESC, 1, 2 LIMIT 15""")
_MCP = f"""SELECT server, mcp_op AS mcp_tool, count(*) AS calls, count(*) FILTER (success = 'false') AS failures, round(avg(ms)) AS avg_ms,
    CAST(sum(bytes) AS BIGINT) AS total_bytes, round_even(quantile_cont(ms, 0.95), 0) AS p95_ms,
    CAST(round_even(quantile_cont(CAST(bytes AS DOUBLE), 0.95), 0) AS BIGINT) AS p95_bytes {_T} AND tn = 'mcp_tool' GROUP BY 1, 2"""
query("mcp_usage", lambda t: A.mcp_usage(t.logs, W), f"""
    WITH u AS ({_MCP}) SELECT *, CAST(sum(calls) OVER (PARTITION BY server) AS BIGINT) AS server_calls FROM u""")
query("mcp_server_rollup", lambda t: A.mcp_server_rollup(A.mcp_usage(t.logs, W)), f"""
    WITH u AS ({_MCP}), s AS (
      SELECT server, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(failures) AS BIGINT) AS failures, count(*) AS tools,
             sum(avg_ms * calls) / sum(calls) AS mean_ms, max(p95_ms) AS p95_ms, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
             max(p95_bytes) AS p95_bytes FROM u GROUP BY server)
    SELECT server, calls, failures, tools, round(mean_ms, 6) AS mean_ms, p95_ms, total_bytes, p95_bytes,
           round(failures / calls, 6) AS failure_rate, round(calls * 100.0 / sum(calls) OVER (), 6) AS share_percent FROM s""")
_SUB = """WITH d AS (SELECT * FROM logs WHERE en = 'tool_result' AND tn = 'Agent'),
    m AS (SELECT * FROM logs WHERE en = 'api_request' AND agent IS NULL)"""
query("subagent_usage", lambda t: A.subagent_usage(t.logs, CP), _SUB + """
    SELECT d.subagent AS identifier, coalesce(m.model, 'unknown') AS model, count(*) AS calls
    FROM d ASOF LEFT JOIN m ON m.sid = d.sid AND m.ts <= d.ts
    WHERE d.ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2""")
query("subagent_cost", lambda t: A.subagent_cost(t.logs, t.spans, W, cfg=_execution()), """
    SELECT d.subagent AS identifier, q.model, round(coalesce(CAST(sum(q.cost) AS DOUBLE), 0), 6) AS cost_usd
    FROM logs d JOIN spans x ON x.name = 'claude_code.tool' AND x.tuid = d.tuid
    JOIN spans c ON c.parent = x.sp AND c.name = 'claude_code.llm_request'
    JOIN logs q ON q.en = 'api_request' AND q.rid = c.rid
    WHERE d.en = 'tool_result' AND d.tn = 'Agent' GROUP BY 1, 2""")


def _execution():
    """In the test data the tool span, not an execution span, carries the call id."""
    from spanloom.config import TelemetryConfig

    return TelemetryConfig(tool_execution_span="claude_code.tool")


_SKILL = """WITH i AS (SELECT skill AS identifier, pid, first(model ORDER BY ts, id) AS model, min(ts) AS turn_at FROM logs
    WHERE en = 'api_request' AND skill IS NOT NULL AND agent IS NULL GROUP BY 1, 2)"""
query("skill_usage", lambda t: A.skill_usage(t.logs, W), _SKILL + """
    SELECT identifier, model, count(*) AS calls FROM i GROUP BY 1, 2""")
query("skill_cost", lambda t: A.skill_cost(t.logs, W), """
    SELECT skill AS identifier, model, round(CAST(sum(cost) AS DOUBLE), 6) AS cost_usd
    FROM logs WHERE en = 'api_request' AND skill IS NOT NULL GROUP BY 1, 2""")
query("merge_usage_cost", lambda t: A.merge_usage_cost(A.skill_usage(t.logs, W), A.skill_cost(t.logs, W)).drop("cost_by_model"), _SKILL + """
    , u AS (SELECT identifier, count(*) AS calls FROM i GROUP BY 1),
    c AS (SELECT skill AS identifier, CAST(sum(cost) AS DOUBLE) AS cost_usd FROM logs WHERE skill IS NOT NULL GROUP BY 1)
    SELECT identifier, calls, round(cost_usd, 6) AS cost_usd, round(cost_usd / calls, 6) AS cost_per_call FROM u LEFT JOIN c USING (identifier)""")
query("share_of_calls", lambda t: A.with_share(A.tool_calls(t.logs, W)), f"""
    SELECT tool, count(*) AS calls, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_percent {_T} GROUP BY tool""")
