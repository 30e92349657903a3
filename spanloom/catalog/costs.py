"""Checkable queries: tuning findings and cost."""

from spanloom.catalog.base import CP, DAY, W, query
from spanloom.catalog.explore import _execution
from spanloom.operators import cost as C
from spanloom.operators import tuning as R

_T = "FROM logs WHERE en = 'tool_result'"
_PREFIX = "CASE WHEN command IS NULL THEN 'unknown' ELSE 'grep' END"

query("bash_hotspots", lambda t: R.bash_hotspots(t.logs, W), f"""
    SELECT {_PREFIX} AS command_prefix, count(*) AS calls, round(avg(ms)) AS avg_ms, round(avg(bytes)) AS avg_out,
           round_even(quantile_cont(ms, 0.95), 0) AS p95_ms {_T} AND tn = 'Bash' GROUP BY 1""")
query("bash_coverage", lambda t: R.bash_coverage(t.logs, W), f"""
    SELECT count(command) AS with_command, count(*) AS total, count(*) FILTER (command LIKE 'cd %') AS cd_prefixed {_T} AND tn = 'Bash'""")
_OVER = f"""SELECT tool, scope, bytes, count(*) AS occurrences {_T} AND bytes IS NOT NULL AND tn <> 'Agent' GROUP BY 1, 2, 3"""
query("oversized_results", lambda t: R.oversized_results(t.logs, W), _OVER + " ORDER BY bytes DESC, tool, scope LIMIT 10")
_READS = f"""SELECT sid AS session_id, file_path, count(*) AS reads, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 60.0) AS span_minutes,
      round(coalesce(max(gap), 0) / 1e6 / 60.0) AS max_gap_minutes
    FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sid, file_path ORDER BY ts, id) AS gap {_T} AND tn = 'Read')
    GROUP BY 1, 2 HAVING count(*) > 1"""
query("redundant_reads", lambda t: R.redundant_reads(t.logs, W), f"""
    WITH r AS ({_READS} ORDER BY reads DESC, 1, 2 LIMIT 10) SELECT *, CASE WHEN reads >= 3 AND max_gap_minutes <= 5 THEN 'hunting loop'
      WHEN max_gap_minutes >= 30 THEN 'spread across session' ELSE 'tight cluster' END AS pattern FROM r""")
_LOOPS = f"""SELECT sid AS session_id, file_path, count(*) AS failures {_T} AND tn = 'Edit' AND success = 'false'
    GROUP BY 1, 2 HAVING count(*) >= 2"""
query("edit_failure_loops", lambda t: R.edit_failure_loops(t.logs, W), _LOOPS + " ORDER BY failures DESC, 1, 2 LIMIT 10")
_SLOW = f"""SELECT id, tool, scope, CAST(ms AS BIGINT) AS duration_ms, bytes {_T} AND ms >= 1000 AND bytes >= 4000 AND tn <> 'Agent'"""
query("slow_and_large", lambda t: R.slow_and_large(t.logs, W), _SLOW + " ORDER BY ms * bytes DESC, id LIMIT 10")
_FAILED = f"""SELECT sid AS session_id, file_path, count(*) AS failures {_T} AND tn = 'Read' AND success = 'false' GROUP BY 1, 2"""
query("failed_read_paths", lambda t: R.failed_read_paths(t.logs, W), _FAILED)
_GOOD = f"SELECT DISTINCT sid AS session_id, file_path {_T} AND tn = 'Read' AND success = 'true'"
query("successful_read_paths", lambda t: R.successful_read_paths(t.logs, W), _GOOD)
query("path_near_misses", lambda t: R.path_near_misses(t.logs, W), f"""
    WITH f AS ({_FAILED}), g AS ({_GOOD})
    SELECT f.session_id, f.file_path AS failed_path, first(g.file_path ORDER BY levenshtein(f.file_path, g.file_path), g.file_path) AS nearest_path,
           min(levenshtein(f.file_path, g.file_path)) AS edit_distance, f.failures
    FROM f JOIN g USING (session_id) WHERE levenshtein(f.file_path, g.file_path) BETWEEN 1 AND 3
    GROUP BY f.session_id, f.file_path, f.failures""")
query("tuning_suggestions", lambda t: R.suggestions(t.logs, W), f"""
    WITH big AS (SELECT scope, arg_max(struct_pack(tool := tool, bytes := bytes, n := occurrences), bytes * 1000 - ascii(tool)) AS m
                 FROM ({_OVER}) WHERE bytes >= 20000 AND scope <> '' GROUP BY scope),
    foot AS (SELECT tool, count(*) AS calls, sum(bytes) AS total, round_even(quantile_cont(CAST(bytes AS DOUBLE), 0.95), 0) AS p95
             {_T} AND bytes IS NOT NULL AND tn <> 'Agent' GROUP BY tool),
    srv AS (SELECT server, count(*) AS calls, count(*) FILTER (success = 'false') AS bad, sum(bytes) AS total {_T} AND tn = 'mcp_tool' GROUP BY 1),
    shares AS (SELECT *, calls / sum(calls) OVER () AS cs, total / sum(total) OVER () AS bs FROM srv),
    r AS ({_READS}), e AS ({_LOOPS}), s AS ({_SLOW}), cov AS (SELECT count(*) AS n {_T} AND tn = 'Bash'),
    hot AS (SELECT {_PREFIX} AS p, count(*) AS n, round_even(quantile_cont(ms, 0.95), 0) AS p95 {_T} AND tn = 'Bash' GROUP BY 1)
    SELECT 'cd_prefix' AS kind, 'cd' AS subject, CAST(n AS DOUBLE) AS n, CAST(n AS DOUBLE) AS size, CAST(NULL AS VARCHAR) AS extra FROM cov WHERE n >= 10
    UNION ALL (SELECT 'bash', p, n, p95, NULL FROM hot WHERE p95 >= 5000 ORDER BY n DESC, p LIMIT 10)
    UNION ALL (SELECT 'oversized', scope, m.n, m.bytes, m.tool FROM big ORDER BY m.bytes DESC, m.tool, scope LIMIT 3)
    UNION ALL (SELECT 'tail', tool, calls, p95, CAST(total // calls AS VARCHAR) FROM foot
               WHERE calls >= 10 AND p95 >= 20000 AND p95 >= (total // calls) * 3 ORDER BY total DESC, tool LIMIT 2)
    UNION ALL (SELECT 'mcp', server, calls, total, CAST(bad AS VARCHAR) FROM shares
               WHERE bad / calls >= 0.1 OR (total >= 20000 AND bs >= cs * 2) ORDER BY calls DESC, server LIMIT 3)
    UNION ALL (SELECT 'hunting', file_path, reads, span_minutes, session_id FROM r WHERE reads >= 3 AND max_gap_minutes <= 5 ORDER BY reads DESC, session_id, file_path LIMIT 3)
    UNION ALL (SELECT 'edit_loop', file_path, failures, NULL, session_id FROM e ORDER BY failures DESC, session_id, file_path LIMIT 3)
    UNION ALL (SELECT 'slow_large', scope, duration_ms, bytes, tool FROM s ORDER BY duration_ms * bytes DESC, id LIMIT 2)""")

_Q = "FROM logs WHERE en = 'api_request'"
_TOK = """CAST(sum(ti) AS BIGINT) AS input_tokens, CAST(sum(tou) AS BIGINT) AS output_tokens,
    CAST(sum(tcc) AS BIGINT) AS cache_creation_tokens, CAST(sum(tcr) AS BIGINT) AS cache_read_tokens"""
_USD = "round(coalesce(CAST(sum(cost) AS DOUBLE), 0), 6)"

query("cost_by_category", lambda t: C.cost_by_category(t.logs, W, DAY), f"""
    SELECT category, epoch_us(b) AS bucket, CAST(grouping(category) AS BIGINT) AS category_grouped, CAST(grouping(b) AS BIGINT) AS bucket_grouped,
           {_USD} AS cost_usd, count(*) AS requests, {_TOK}
    FROM (SELECT *, date_trunc('day', ts) AS b {_Q}) GROUP BY GROUPING SETS ((), (category), (category, b))""")
query("prior_cost", lambda t: C.prior_cost(t.logs, CP), f"SELECT {_USD} AS prior_total {_Q} AND ts < TIMESTAMP '2024-01-16'")
_GRID = f"SELECT model, effort, {_USD} AS cost_usd, count(*) AS requests, {_TOK} {_Q} GROUP BY 1, 2"
query("cost_by_model_effort", lambda t: C.cost_by_model_effort(t.logs, W), _GRID)
_TOP = f"SELECT sid AS session_id, {_USD} AS cost_usd, count(*) AS requests {_Q} GROUP BY 1 ORDER BY cost_usd DESC, 1 LIMIT 10"
query("top_cost_sessions", lambda t: C.top_cost_sessions(t.logs, W), _TOP)
_SPLIT = ", ".join(f"round(coalesce(CAST(sum(cost) FILTER (category = '{c}') AS DOUBLE), 0), 6) AS {c.lower()}_usd"
                   for c in ("MAIN_LOOP", "SUBAGENT", "SKILL", "AUXILIARY"))
query("session_category_cost", lambda t: C.session_category_cost(t.logs, W, t.logs), f"SELECT sid AS session_id, {_SPLIT} {_Q} GROUP BY 1")
query("cost_headline", lambda t: C.cost_headline(t.logs, CP), f"""
    WITH s AS (SELECT coalesce(CAST(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-16') AS DOUBLE), 0) AS cur,
      coalesce(CAST(sum(cost) FILTER (ts < TIMESTAMP '2024-01-16') AS DOUBLE), 0) AS pri, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS requests,
      CAST(sum(ti) FILTER (ts >= TIMESTAMP '2024-01-16') AS BIGINT) AS input_tokens, CAST(sum(tou) FILTER (ts >= TIMESTAMP '2024-01-16') AS BIGINT) AS output_tokens,
      CAST(sum(tcc) FILTER (ts >= TIMESTAMP '2024-01-16') AS BIGINT) AS cache_creation_tokens,
      CAST(sum(tcr) FILTER (ts >= TIMESTAMP '2024-01-16') AS BIGINT) AS cache_read_tokens {_Q})
    SELECT round(cur, 6) AS current_usd, round(pri, 6) AS prior_usd, requests, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
           round((cur - pri) / pri * 100, 6) AS delta_percent, round(cur / 360, 6) AS burn_usd_per_hour, round(cur / 360 * 720, 6) AS projected_30d_usd FROM s""")
query("cost_category_shares", lambda t: C.category_shares(t.logs, t.spans, W, cfg=_execution()), f"""
    WITH c AS (SELECT category, CAST(sum(cost) AS DOUBLE) AS usd, count(*) AS requests {_Q} GROUP BY 1),
    sub AS (SELECT sum(CAST(q.cost AS DOUBLE)) AS usd FROM logs d JOIN spans x ON x.name = 'claude_code.tool' AND x.tuid = d.tuid
       JOIN spans c ON c.parent = x.sp AND c.name = 'claude_code.llm_request' JOIN logs q ON q.rid = c.rid WHERE d.en = 'tool_result' AND d.tn = 'Agent'),
    ski AS (SELECT sum(CAST(cost AS DOUBLE)) AS usd FROM logs WHERE skill IS NOT NULL)
    SELECT category, round(usd, 6) AS cost_usd, requests, CAST(floor(usd / sum(usd) OVER () * 100 + 0.5) AS BIGINT) AS share_percent,
           round(CASE category WHEN 'SUBAGENT' THEN (SELECT usd FROM sub) WHEN 'SKILL' THEN (SELECT usd FROM ski) END, 6) AS identified_usd FROM c""")
query("cost_trend_series", lambda t: C.cost_trend_series(t.logs, W, DAY), f"""
    SELECT epoch_us(date_trunc('day', ts)) AS bucket, {_SPLIT.replace('_usd', '')} {_Q} GROUP BY 1""")
query("model_mix", lambda t: C.model_mix(C.cost_by_model_effort(t.logs, W)), f"SELECT model, {_USD} AS cost_usd {_Q} GROUP BY 1")
query("identifier_shares", lambda t: C.identifier_shares(C.tools.subagent_cost(t.logs, t.spans, W, cfg=_execution())), """
    WITH s AS (SELECT d.subagent AS identifier, sum(CAST(q.cost AS DOUBLE)) AS usd FROM logs d JOIN spans x ON x.name = 'claude_code.tool' AND x.tuid = d.tuid
       JOIN spans c ON c.parent = x.sp AND c.name = 'claude_code.llm_request' JOIN logs q ON q.rid = c.rid
       WHERE d.en = 'tool_result' AND d.tn = 'Agent' GROUP BY 1)
    SELECT identifier, round(usd, 6) AS cost_usd, CAST(floor(usd / sum(usd) OVER () * 100 + 0.5) AS BIGINT) AS share_percent FROM s""")
query("cost_breakdown_sessions", lambda t: C.cost_breakdown(t.logs, t.spans, W).sessions, f"""
    WITH t AS ({_TOP}), c AS (SELECT sid AS session_id, {_SPLIT} {_Q} GROUP BY 1),
    p AS (SELECT sid AS session_id, regexp_replace(first(prompt ORDER BY ts, id), '\\s+', ' ', 'g') AS first_user_prompt FROM logs
          WHERE en = 'user_prompt' GROUP BY 1)
    SELECT * FROM t LEFT JOIN c USING (session_id) LEFT JOIN p USING (session_id)""")

_M = "FROM moving WHERE metric = 'claude_code.cost.usage'"
query("counter_cost_current_prior", lambda t: C.counter_cost_current_prior(t.points, CP), f"""
    SELECT round(coalesce(sum(d) FILTER (ts >= TIMESTAMP '2024-01-16'), 0), 6) AS current_total,
           round(coalesce(sum(d) FILTER (ts < TIMESTAMP '2024-01-16'), 0), 6) AS prior_total {_M}""")
query("counter_cost_breakdown", lambda t: C.counter_cost_breakdown(t.points, W, DAY), f"""
    SELECT epoch_us(b) AS bucket, model, CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(b) = 0 THEN 'bucket' ELSE 'total' END AS row_type,
           round(sum(d), 6) AS amount FROM (SELECT *, date_trunc('day', ts) AS b {_M}) GROUP BY GROUPING SETS ((), (b), (model))""")
query("cost_summary", lambda t: C.cost_summary(t.points, CP), """
    WITH s AS (SELECT coalesce(sum(d) FILTER (metric LIKE '%cost%' AND ts >= TIMESTAMP '2024-01-16'), 0) AS cur,
                      coalesce(sum(d) FILTER (metric LIKE '%cost%' AND ts < TIMESTAMP '2024-01-16'), 0) AS pri,
                      CAST(sum(d) FILTER (metric LIKE '%token%' AND ts >= TIMESTAMP '2024-01-16') AS BIGINT) AS tok FROM moving)
    SELECT round(cur, 6) AS spend_usd, round(pri, 6) AS prior_usd, tok AS total_tokens, round((cur - pri) / pri * 100, 6) AS delta_percent,
           round(cur / 360, 6) AS burn_usd_per_hour, round(cur / 360 * 720, 6) AS projected_30d_usd, round(cur / (tok / 1000), 6) AS cost_per_1k_tokens FROM s""")
query("cost_summary_trend", lambda t: C.cost_summary_trend(t.points, W, 30), f"""
    WITH axis AS (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS b FROM range(31) r(i))
    SELECT epoch_us(a.b) AS bucket, round(coalesce(sum(m.d), 0), 6) AS cost_usd FROM axis a LEFT JOIN (SELECT * {_M}) m ON date_trunc('day', m.ts) = a.b GROUP BY a.b""")
query("cost_summary_models", lambda t: C.cost_summary_models(t.points, W), f"""
    SELECT model, round(sum(d), 6) AS cost_usd, CAST(floor(sum(d) / sum(sum(d)) OVER () * 100 + 0.5) AS BIGINT) AS share_percent {_M} GROUP BY model""")
query("span_costs", lambda t: C.span_costs(t.logs), f"SELECT tr AS trace_id, sp AS span_id, {_USD} AS cost_usd {_Q} GROUP BY 1, 2")
query("trace_costs", lambda t: C.trace_costs(t.logs), f"SELECT tr AS trace_id, {_USD} AS cost_usd {_Q} GROUP BY 1")
query("span_efforts", lambda t: C.span_efforts(t.spans, t.logs), """
    SELECT s.tr AS trace_id, s.sp AS span_id, l.effort FROM spans s JOIN logs l ON l.rid = s.rid
    WHERE s.name = 'claude_code.llm_request' AND l.effort IS NOT NULL""")
