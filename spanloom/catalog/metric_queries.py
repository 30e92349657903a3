"""Checkable queries: counters, trends, calendar, housekeeping."""

from datetime import date

from spanloom.catalog.base import CP, DAY, W, query
from spanloom.config import CFG, TimeRange, utc
from spanloom.operators import metrics as M
from spanloom.operators import retention as O
from spanloom.operators import trends as P
from spanloom.operators import usage_calendar as D

NAMES = [CFG.cost_metric, CFG.token_metric, CFG.active_metric, CFG.session_metric]
_TOKENS = "FROM moving WHERE metric LIKE '%token%'"
_CUR, _PRI = "ts >= TIMESTAMP '2024-01-16'", "ts < TIMESTAMP '2024-01-16'"
_KINDS = """CAST(coalesce(sum(d) FILTER (tt = 'input'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(d) FILTER (tt = 'output'), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(d) FILTER (tt = 'cacheCreation'), 0) AS BIGINT) AS cache_creation_tokens,
    CAST(coalesce(sum(d) FILTER (tt = 'cacheRead'), 0) AS BIGINT) AS cache_read_tokens"""

query("token_breakdown", lambda t: M.token_breakdown(t.points, W, DAY), f"""
    SELECT epoch_us(b) AS bucket, tt AS token_type, model, CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(b) = 0 THEN 'bucket' ELSE 'total' END AS row_type,
      CAST(sum(d) AS BIGINT) AS total, {_KINDS.replace("(tt =", "(k2 =")} FROM (SELECT *, tt AS k2, date_trunc('day', ts) AS b {_TOKENS}) GROUP BY GROUPING SETS ((b, tt), (model), ())""")
query("token_usage", lambda t: M.token_usage(t.points, W), f"""
    WITH s AS (SELECT {_KINDS} {_TOKENS})
    SELECT *, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS total_tokens,
           round(cache_read_tokens / (input_tokens + cache_creation_tokens + cache_read_tokens), 6) AS cache_read_ratio FROM s""")
query("token_usage_points", lambda t: M.token_usage_points(t.points, W, DAY), f"""
    SELECT epoch_us(date_trunc('day', ts)) AS bucket, {_KINDS} {_TOKENS} GROUP BY 1""")
query("token_usage_models", lambda t: M.token_usage_models(t.points, W), f"""
    SELECT model, CAST(sum(d) AS BIGINT) AS total, {_KINDS}, CAST(floor(sum(d) / sum(sum(d)) OVER () * 100 + 0.5) AS BIGINT) AS share_percent {_TOKENS} GROUP BY model""")
query("total_tokens", lambda t: M.total_tokens(t.points, W), f"SELECT CAST(sum(d) AS BIGINT) AS total_tokens {_TOKENS}")
_BOTH = f"CAST(coalesce(sum(d) FILTER ({_CUR}), 0) AS BIGINT) AS current_total, CAST(coalesce(sum(d) FILTER ({_PRI}), 0) AS BIGINT) AS prior_total"
query("tokens_current_prior", lambda t: M.tokens_current_prior(t.points, CP), f"SELECT {_BOTH} {_TOKENS}")
query("token_type_current_prior", lambda t: M.token_type_current_prior(t.points, CP), f"SELECT tt AS token_type, {_BOTH} {_TOKENS.replace('moving', 'points')} GROUP BY tt")
_HEALTH = "CASE WHEN {n} < 1000 THEN 'ok' WHEN {n} <= 5000 THEN 'warn' ELSE 'bad' END"
query("metric_catalog", lambda t: M.metric_catalog(t.points, W), f"""
    SELECT metric AS metric_name, max(unit) AS unit, count(DISTINCT stream) AS cardinality, {_HEALTH.format(n='count(DISTINCT stream)')} AS health FROM points GROUP BY metric""")
query("catalog_sparklines", lambda t: M.catalog_sparklines(t.points, W), """
    SELECT metric AS metric_name, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 324000000000 AS bucket_index, count(*) AS row_count FROM points GROUP BY 1, 2""")
query("metric_names", lambda t: M.metric_names(t.points, t.kept), "SELECT metric AS metric_name, min(unit) AS unit FROM points GROUP BY metric")
_DBL = f"round(coalesce(sum(d) FILTER ({_CUR}), 0), 6) AS current_total, round(coalesce(sum(d) FILTER ({_PRI}), 0), 6) AS prior_total"
query("metric_totals", lambda t: M.metric_totals(t.points, NAMES, CP), f"SELECT metric AS metric_name, {_DBL} FROM moving GROUP BY metric")
query("metric_totals_filtered", lambda t: M.metric_totals(t.points, [CFG.token_metric], CP, wanted={"model": "m1", "decision": None}),
      f"SELECT metric AS metric_name, {_DBL} {_TOKENS} AND model = 'm1' GROUP BY metric")
query("metric_cardinality", lambda t: M.metric_cardinality(t.points, NAMES, W), "SELECT metric AS metric_name, count(DISTINCT stream) AS cardinality FROM moving GROUP BY metric")
query("metric_cardinality_filtered", lambda t: M.metric_cardinality(t.points, [CFG.token_metric], W, wanted={"type": "input"}),
      f"SELECT metric AS metric_name, count(DISTINCT stream) AS cardinality {_TOKENS} AND tt = 'input' GROUP BY metric")
_BIN = "metric AS metric_name, epoch_us(date_trunc('day', ts)) AS bucket"
query("metric_trend_sum", lambda t: M.metric_trend_sum(t.points, NAMES, W, DAY), f"SELECT {_BIN}, round(sum(d), 6) AS total FROM moving GROUP BY 1, 2")
query("metric_trend_avg", lambda t: M.metric_trend_avg(t.points, NAMES, W, DAY), f"SELECT {_BIN}, round(avg(d), 6) AS aggregated_value FROM moving WHERE d > 0 GROUP BY 1, 2")
query("metric_trend_p95", lambda t: M.metric_trend_p95(t.points, NAMES, W, DAY), f"SELECT {_BIN}, round(quantile_cont(d, 0.95), 6) AS aggregated_value FROM moving WHERE d > 0 GROUP BY 1, 2")
query("metric_trend_count", lambda t: M.metric_trend_count(t.points, NAMES, W, DAY, wanted={"model": "m0"}),
      f"SELECT {_BIN}, CAST(count(*) AS DOUBLE) AS aggregated_value FROM moving WHERE d > 0 AND model = 'm0' GROUP BY 1, 2")
query("metric_splits", lambda t: M.metric_splits(t.points, NAMES, W), """
    SELECT metric AS metric_name, 'model' AS attribute, model AS label, round(sum(d), 6) AS total FROM moving WHERE model IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT metric, 'type', tt, round(sum(d), 6) FROM moving WHERE tt IS NOT NULL GROUP BY 1, 3""")
query("metric_attribute_facets", lambda t: M.metric_attribute_facets(t.points, CFG.token_metric, W), f"""
    WITH s AS (SELECT DISTINCT stream, sid, model, tt, repo {_TOKENS}),
    p AS (SELECT 'session.id' AS k, sid AS v FROM s UNION ALL SELECT 'model', model FROM s UNION ALL SELECT 'type', tt FROM s
          UNION ALL SELECT 'vcs.repository.url.full', repo FROM s WHERE repo IS NOT NULL),
    c AS (SELECT k, v, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT k AS attribute_key, v AS attribute_value, n AS stream_count FROM c""")
query("metric_series", lambda t: M.metric_series(t.points, CP, kept=t.kept), f"""
    WITH known AS (SELECT metric, min(unit) AS unit FROM points GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('claude_code.lines_of_code.count', ''),
        ('claude_code.code_edit_tool.decision', ''), ('claude_code.commit.count', ''), ('claude_code.pull_request.count', ''))),
    b AS (SELECT metric, least((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-16')) // 54000000000, 23) AS i, sum(d) AS t FROM moving WHERE {_CUR} GROUP BY 1, 2),
    s AS (SELECT metric, coalesce(sum(d) FILTER ({_CUR}), 0) AS cur, coalesce(sum(d) FILTER ({_PRI}), 0) AS pri, count(DISTINCT stream) FILTER ({_CUR}) AS n FROM moving GROUP BY 1)
    SELECT k.metric AS metric_name, k.unit, round(coalesce(cur, 0), 6) AS total, round(coalesce(pri, 0), 6) AS prior,
      round(coalesce((SELECT max(t) FROM b WHERE b.metric = k.metric), 0), 6) AS peak, coalesce(n, 0) AS cardinality, round(coalesce(cur, 0) / 360, 6) AS rate_per_hour,
      round(CASE WHEN pri <> 0 THEN (cur - pri) / pri * 100 ELSE 0 END, 6) AS delta_percent, {_HEALTH.format(n='coalesce(n, 0)')} AS health, TRUE AS curated
    FROM known k LEFT JOIN s USING (metric)""")
query("metric_series_trend", lambda t: M.metric_series_trend(t.points, W, kept=t.kept), """
    WITH n AS (SELECT DISTINCT metric FROM points), axis AS (SELECT metric, i FROM n, range(24) r(i)),
    b AS (SELECT metric, least((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 108000000000, 23) AS i, sum(d) AS t FROM moving GROUP BY 1, 2)
    SELECT metric AS metric_name, i AS bucket_index, round(coalesce(t, 0), 4) AS total FROM axis LEFT JOIN b USING (metric, i)""")
query("metric_points_page", lambda t: M.metric_points_page(t.points, W, ["model=m1", "type=output"], 1, 50).select("id", "timestamp", "session_id", "value_long"), """
    SELECT id, epoch_us(ts) AS timestamp, sid AS session_id, CAST(cur AS BIGINT) AS value_long FROM points WHERE model = 'm1' AND tt = 'output' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 50""")
query("metric_points_count", lambda t: M.metric_points_count(t.points, W, ["model=m1"]), "SELECT count(*) AS row_count FROM points WHERE model = 'm1'")

_RP = """SELECT id, epoch_us(ts) AS request_timestamp, {v} AS request_value, tr AS trace_id, rid AS request_id, FALSE AS request_failed
    FROM logs WHERE en = 'api_request' """
_RPT, _RPC = _RP.format(v="CAST(ti + tou + tcc + tcr AS DOUBLE)"), _RP.format(v="CAST(cost AS DOUBLE)")
query("request_points_tokens", lambda t: M.request_points_tokens(t.logs, W), _RPT)
query("request_points_cost", lambda t: M.request_points_cost(t.logs, W), _RPC)
_EX = f"""p AS ({_RPT}), q AS (SELECT quantile_cont(request_value, 0.5) AS p50, quantile_cont(request_value, 0.95) AS p95, quantile_cont(request_value, 0.99) AS p99 FROM p),
    ids AS ((SELECT id FROM p ORDER BY request_value DESC, request_timestamp DESC LIMIT 1)
      UNION (SELECT id FROM p, q ORDER BY abs(request_value - p50), request_timestamp DESC LIMIT 1)
      UNION (SELECT id FROM p, q ORDER BY abs(request_value - p95), request_timestamp DESC LIMIT 1)
      UNION (SELECT id FROM p, q ORDER BY abs(request_value - p99), request_timestamp DESC LIMIT 1))"""
query("select_exemplars", lambda t: M.select_exemplars(M.request_points_tokens(t.logs, W)), f"""
    WITH {_EX} SELECT p.* EXCLUDE (trace_id), CASE WHEN ids.id IS NOT NULL THEN trace_id END AS trace_id, ids.id IS NOT NULL AS is_exemplar FROM p LEFT JOIN ids USING (id)""")
query("exemplar_spans", lambda t: M.exemplar_spans(t.spans, M.select_exemplars(M.request_points_tokens(t.logs, W))), f"""
    WITH {_EX} SELECT s.tr AS trace_id, s.rid AS request_id, s.sp AS span_id FROM spans s JOIN p ON p.request_id = s.rid AND p.trace_id = s.tr JOIN ids ON ids.id = p.id
    WHERE s.name = 'claude_code.llm_request'""")
query("nearest_rank_summary", lambda t: M.nearest_rank_summary(M.request_points_cost(t.logs, W)), f"""
    WITH p AS ({_RPC}) SELECT round(quantile_disc(request_value, 0.5), 6) AS p50, round(quantile_disc(request_value, 0.95), 6) AS p95,
      round(quantile_disc(request_value, 0.99), 6) AS p99, count(*) AS request_count FROM p""")

_SEC = 185142
_PB = f"""CASE WHEN {_CUR} THEN 'current' ELSE 'prior' END AS period,
    (epoch_us(ts) - epoch_us(CASE WHEN {_CUR} THEN TIMESTAMP '2024-01-16' ELSE TIMESTAMP '2024-01-01' END)) // {_SEC}000000 AS i"""
_SEEN = "(metric LIKE '%cost%' OR metric LIKE '%active%')"
query("totals_current_prior", lambda t: P.totals_current_prior(t.points, CP), f"""
    SELECT 'cost' AS row_type, CAST(NULL AS VARCHAR) AS token_type, {_DBL} FROM moving WHERE metric LIKE '%cost%'
    UNION ALL SELECT 'token_total', NULL, {_DBL} {_TOKENS} UNION ALL SELECT 'token_type', tt, {_DBL} {_TOKENS} GROUP BY tt""")
query("sessions_current_prior", lambda t: P.sessions_current_prior(t.points, CP, kept=t.kept), f"""
    WITH l AS (SELECT sid, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM moving WHERE {_SEEN} GROUP BY sid),
    w AS (SELECT DISTINCT sid, CASE WHEN {_CUR} THEN 'current' ELSE 'prior' END AS period FROM moving WHERE {_SEEN})
    SELECT period, count(*) AS session_count, round(avg(s), 6) AS avg_duration_seconds FROM w JOIN l USING (sid) GROUP BY period""")
_SPARK = f"""c AS (SELECT period, i, coalesce(sum(d) FILTER (metric LIKE '%cost%'), 0) AS cost, CAST(coalesce(sum(d) FILTER (metric LIKE '%token%'), 0) AS BIGINT) AS tok,
        sum(d) FILTER (tt = 'input') AS tin, sum(d) FILTER (tt = 'cacheCreation') AS tcc, sum(d) FILTER (tt = 'cacheRead') AS tcr
      FROM (SELECT *, {_PB} FROM moving WHERE metric LIKE '%cost%' OR metric LIKE '%token%') GROUP BY 1, 2),
    l AS (SELECT sid, (epoch_us(max(ts) FILTER (d <> 0)) - epoch_us(min(ts) FILTER (d <> 0))) / 1e6 AS s,
                 (epoch_us(max(ts) FILTER (d <> 0)) - epoch_us(min(ts))) / 1e6 AS sa FROM points WHERE {_SEEN} GROUP BY sid),
    w AS (SELECT DISTINCT sid, period, i FROM (SELECT *, {_PB} FROM moving WHERE {_SEEN})),
    s AS (SELECT period, i, count(*) AS n, avg(s) AS dur, avg(sa) AS dura FROM w JOIN l USING (sid) GROUP BY 1, 2)"""
query("sparklines_combined", lambda t: P.sparklines_combined(t.points, CP, _SEC, kept=t.kept), f"""
    WITH {_SPARK} SELECT period, i AS bucket_index, round(coalesce(cost, 0), 6) AS cost_total, coalesce(tok, 0) AS token_total, coalesce(n, 0) AS session_count,
      round(coalesce(dur, 0), 6) AS avg_duration_seconds FROM c FULL JOIN s USING (period, i)""")
query("token_type_sparklines", lambda t: P.token_type_sparklines(t.points, CP, _SEC), f"""
    SELECT period, i AS bucket_index, tt AS token_type, CAST(sum(d) AS BIGINT) AS total FROM (SELECT *, {_PB} {_TOKENS}) GROUP BY 1, 2, 3""")
_DI = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000"
query("cost_token_trend", lambda t: P.cost_token_trend(t.points, W, DAY), f"""
    SELECT {_DI} AS bucket_index, round(coalesce(sum(d) FILTER (metric LIKE '%cost%'), 0), 6) AS cost_total, CAST(coalesce(sum(d) FILTER (metric LIKE '%token%'), 0) AS BIGINT) AS token_total
    FROM points WHERE metric LIKE '%cost%' OR metric LIKE '%token%' GROUP BY 1""")
query("token_type_trend", lambda t: P.token_type_trend(t.points, W, DAY), f"""
    SELECT {_DI} AS bucket_index, tt AS token_type, CAST(sum(d) AS BIGINT) AS total FROM points WHERE metric LIKE '%token%' GROUP BY 1, 2""")
query("session_trend", lambda t: P.session_trend(t.points, W, DAY, kept=t.kept), f"""
    WITH l AS (SELECT sid, (epoch_us(max(ts) FILTER (d <> 0)) - epoch_us(min(ts))) / 1e6 AS s FROM points WHERE {_SEEN} GROUP BY sid),
    w AS (SELECT DISTINCT sid, {_DI} AS i FROM moving WHERE {_SEEN})
    SELECT i AS bucket_index, count(*) AS session_count, round(avg(s), 6) AS avg_duration_seconds FROM w JOIN l USING (sid) GROUP BY i""")
_TR = "FROM logs WHERE en = 'tool_result'"
query("tool_failure_current_prior", lambda t: P.tool_failure_current_prior(t.logs, CP), f"""
    SELECT count(*) FILTER ({_CUR}) AS current_calls, count(*) FILTER ({_CUR} AND success = 'false') AS current_failures,
      count(*) FILTER ({_PRI}) AS prior_calls, count(*) FILTER ({_PRI} AND success = 'false') AS prior_failures {_TR}""")
query("tool_failure_trend", lambda t: P.tool_failure_trend(t.logs, W, DAY), f"""
    SELECT {_DI} AS bucket_index, count(*) AS total_calls, count(*) FILTER (success = 'false') AS failures {_TR} GROUP BY 1""")
query("session_failures_current_prior", lambda t: P.session_failures_current_prior(t.logs, CP), f"""
    SELECT count(DISTINCT sid) FILTER ({_CUR}) AS current_session_failures, count(DISTINCT sid) FILTER ({_PRI}) AS prior_session_failures {_TR} AND success = 'false'""")
query("session_failures_trend", lambda t: P.session_failures_trend(t.logs, W, DAY), f"""
    SELECT {_DI} AS bucket_index, count(DISTINCT sid) AS failed_sessions {_TR} AND success = 'false' GROUP BY 1""")
_SUMS = f"""{_SPARK}, tot AS (SELECT period, sum(cost) AS cost, sum(tok) AS tok, sum(tin) AS tin, sum(tcc) AS tcc, sum(tcr) AS tcr FROM c GROUP BY 1),
    ws AS (SELECT DISTINCT sid, period FROM w), ss AS (SELECT period, count(*) AS n, avg(s) AS dur FROM ws JOIN l USING (sid) GROUP BY 1),
    tf AS (SELECT CASE WHEN {_CUR} THEN 'current' ELSE 'prior' END AS period, count(*) AS calls, count(*) FILTER (success = 'false') AS bad,
             count(DISTINCT sid) FILTER (success = 'false') AS bads {_TR} GROUP BY 1),
    f AS (SELECT period, unnest([
      {{'m': 'total_cost', 'v': cost}}, {{'m': 'cost_per_session', 'v': cost / n}}, {{'m': 'blended_rate_per_1m', 'v': cost / tok * 1e6}},
      {{'m': 'cache_read_ratio_pct', 'v': tcr / (tin + tcc + tcr) * 100}}, {{'m': 'tokens_total', 'v': CAST(tok AS DOUBLE)}}, {{'m': 'tokens_per_session', 'v': tok / n}},
      {{'m': 'tool_errors', 'v': CAST(bad AS DOUBLE)}}, {{'m': 'error_rate_pct', 'v': bad / calls * 100}}, {{'m': 'session_failures', 'v': CAST(bads AS DOUBLE)}},
      {{'m': 'sessions', 'v': CAST(n AS DOUBLE)}}, {{'m': 'avg_duration_min', 'v': dur / 60}}]) AS e FROM tot JOIN ss USING (period) JOIN tf USING (period))"""
query("trends", lambda t: P.trends(t.points, t.logs, CP, kept=t.kept), f"""
    WITH {_SUMS}, x AS (SELECT e.m AS metric, max(e.v) FILTER (period = 'prior') AS before, max(e.v) FILTER (period = 'current') AS after FROM f GROUP BY 1),
    y AS (SELECT *, CASE WHEN metric IN ('cache_read_ratio_pct', 'sessions') THEN 'up' ELSE 'down' END AS good,
      CASE WHEN metric LIKE '%_pct' THEN after - before WHEN before <> 0 THEN (after - before) / abs(before) * 100 WHEN after = 0 THEN 0 ELSE 100 END AS delta FROM x),
    z AS (SELECT *, CASE WHEN abs(delta) < 2 THEN 'flat' WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction FROM y)
    SELECT metric, round(before, 6) AS before, round(after, 6) AS after, good AS good_direction, round(delta, 6) AS delta, direction,
      CASE WHEN direction = 'flat' THEN 'flat' WHEN direction = good THEN 'good' ELSE 'bad' END AS verdict,
      round(abs(before) / (abs(before) + abs(after)) * 100, 6) AS before_share_percent FROM z""")
query("trend_series", lambda t: P.trend_series(t.points, t.logs, CP, "cost", kept=t.kept), f"""
    WITH {_SPARK}, axis AS (SELECT p, i FROM (VALUES ('prior'), ('current')) v(p), range(7) r(i)),
    j AS (SELECT a.p AS period, a.i, coalesce(c.cost, 0) AS cost, coalesce(c.tok, 0) AS tok, coalesce(s.n, 0) AS n FROM axis a
          LEFT JOIN c ON c.period = a.p AND c.i = a.i LEFT JOIN s ON s.period = a.p AND s.i = a.i)
    SELECT 'total_cost' AS metric, period, i AS bucket_index, round(cost, 6) AS value FROM j
    UNION ALL SELECT 'cost_per_session', period, i, round(CASE WHEN n > 0 THEN cost / n ELSE 0 END, 6) FROM j
    UNION ALL SELECT 'blended_rate_per_1m', period, i, round(CASE WHEN tok > 0 THEN cost / tok * 1e6 ELSE 0 END, 6) FROM j""")
query("trend_series_activity", lambda t: P.trend_series(t.points, t.logs, CP, "activity", kept=t.kept), f"""
    WITH {_SPARK}, axis AS (SELECT p, i FROM (VALUES ('prior'), ('current')) v(p), range(7) r(i)),
    j AS (SELECT a.p AS period, a.i, coalesce(s.n, 0) AS n, coalesce(s.dura, 0) AS dur FROM axis a LEFT JOIN s ON s.period = a.p AND s.i = a.i)
    SELECT 'sessions' AS metric, period, i AS bucket_index, CAST(n AS DOUBLE) AS value FROM j
    UNION ALL SELECT 'avg_duration_min', period, i, round(dur / 60, 6) FROM j""")

# New York is five hours behind UTC throughout the test data.
NY = "America/New_York"
NYW = TimeRange(utc("2024-01-01T05:00:00"), utc("2024-01-31T05:00:00"))
FIRST, LAST = date(2024, 1, 1), date(2024, 1, 30)
_LOCAL = "(ts - INTERVAL 5 HOUR)"
_IN = "ts >= TIMESTAMP '2024-01-01 05:00:00' AND ts < TIMESTAMP '2024-01-31 05:00:00'"
_DAYS = f"""SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, coalesce(sum(d) FILTER (metric LIKE '%cost%'), 0) AS cost_usd, coalesce(sum(d) FILTER (metric LIKE '%token%'), 0) AS tokens,
    coalesce(sum(d) FILTER (metric LIKE '%active%'), 0) AS active_seconds, count(DISTINCT sid) FILTER {_SEEN.replace('(', '(', 1)} AS sessions
    FROM moving WHERE metric NOT LIKE '%session%' AND {_IN} GROUP BY 1"""
query("daily_counters", lambda t: D.daily_counters(t.points, NYW, NY), f"""
    WITH x AS ({_DAYS}) SELECT day, round(cost_usd, 6) AS cost_usd, round(tokens, 6) AS tokens, round(active_seconds, 6) AS active_seconds,
      CAST(0 AS DOUBLE) AS commits, CAST(0 AS DOUBLE) AS pull_requests, sessions FROM x""")
# The test data has no line counts; two token types stand in for them.
_LINES = type(CFG)(lines_metric=CFG.token_metric)
query("daily_splits", lambda t: D.daily_splits(t.points, NYW, NY, cfg=_LINES, line_types=("input", "output")), f"""
    SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, round(coalesce(sum(d) FILTER (tt = 'input'), 0), 6) AS lines_added,
      round(coalesce(sum(d) FILTER (tt = 'output'), 0), 6) AS lines_removed,
      CAST(0 AS DOUBLE) AS decisions_accepted, CAST(0 AS DOUBLE) AS decisions_rejected {_TOKENS} AND {_IN} GROUP BY 1""")
query("daily_cost_by_model", lambda t: D.daily_cost_by_model(t.points, NYW, NY), f"""
    SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, model, round(sum(d), 6) AS cost_usd FROM moving WHERE metric LIKE '%cost%' AND {_IN} GROUP BY 1, 2 HAVING sum(d) > 0""")
_HOURS = f"""SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, CAST(hour({_LOCAL}) AS BIGINT) AS hour, coalesce(sum(d) FILTER (metric LIKE '%cost%'), 0) AS cost_usd,
    coalesce(sum(d) FILTER (metric LIKE '%token%'), 0) AS tokens, coalesce(sum(d) FILTER (metric LIKE '%active%'), 0) AS active_seconds
    FROM moving WHERE metric NOT LIKE '%session%' AND {_IN} GROUP BY 1, 2"""
query("hourly_counters", lambda t: D.hourly_counters(t.points, NYW, NY), f"""
    WITH x AS ({_HOURS}) SELECT day, hour, round(cost_usd, 6) AS cost_usd, round(tokens, 6) AS tokens, round(active_seconds, 6) AS active_seconds FROM x""")
_INV = f"""SELECT skill, pid, min(ts) AS ts FROM logs WHERE en = 'api_request' AND skill IS NOT NULL AND agent IS NULL AND {_IN} GROUP BY 1, 2"""
query("daily_skill_invocations", lambda t: D.daily_skill_invocations(t.logs, NYW, NY), f"""
    WITH x AS ({_INV}) SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, count(*) AS invocations FROM x GROUP BY 1""")
query("hourly_skill_invocations", lambda t: D.hourly_skill_invocations(t.logs, NYW, NY), f"""
    WITH x AS ({_INV}) SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, CAST(hour({_LOCAL}) AS BIGINT) AS hour, count(*) AS invocations FROM x GROUP BY 1, 2""")
_DISP = f"SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, count(*) AS n {_TR} AND tn = 'Agent' AND {_IN} GROUP BY 1"
query("daily_subagent_dispatches", lambda t: D.daily_subagent_dispatches(t.logs, NYW, NY), f"WITH x AS ({_DISP}) SELECT day, n AS dispatches FROM x")


def _calendar(t):
    return D.usage_calendar(t.points, t.logs, NYW, FIRST, LAST, NY)


_CAL = f"""axis AS (SELECT strftime(DATE '2024-01-01' + CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(30) r(i)), cnt AS ({_DAYS}),
    inv AS ({_INV}), sk AS (SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, count(*) AS n FROM inv GROUP BY 1), sub AS ({_DISP}),
    cal AS (SELECT day, coalesce(cost_usd, 0) AS cost_usd, CAST(round(round(coalesce(tokens, 0), 6)) AS BIGINT) AS tokens, CAST(round(round(coalesce(active_seconds, 0), 6)) AS BIGINT) AS active_seconds,
      coalesce(sessions, 0) AS sessions, coalesce(sk.n, 0) AS skill_calls, coalesce(sub.n, 0) AS subagent_calls
      FROM axis LEFT JOIN cnt USING (day) LEFT JOIN sk USING (day) LEFT JOIN sub USING (day))"""
query("usage_calendar", _calendar, f"""
    WITH {_CAL} SELECT day, round(cost_usd, 6) AS cost_usd, tokens, active_seconds, CAST(0 AS BIGINT) AS commits, CAST(0 AS BIGINT) AS pull_requests, sessions, CAST(0 AS BIGINT) AS lines_added,
      CAST(0 AS BIGINT) AS lines_removed, CAST(0 AS BIGINT) AS decisions_accepted, CAST(0 AS BIGINT) AS decisions_rejected, skill_calls, subagent_calls FROM cal""")
query("usage_calendar_hours", lambda t: D.usage_calendar_hours(t.points, t.logs, NYW, FIRST, LAST, NY), f"""
    WITH axis AS (SELECT strftime(DATE '2024-01-01' + CAST(i AS INTEGER), '%Y-%m-%d') AS day, h AS hour FROM range(30) r(i), range(24) q(h)), x AS ({_HOURS}), inv AS ({_INV}),
    sk AS (SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, CAST(hour({_LOCAL}) AS BIGINT) AS hour, count(*) AS n FROM inv GROUP BY 1, 2)
    SELECT day, hour, round(coalesce(cost_usd, 0), 6) AS cost_usd, CAST(round(round(coalesce(tokens, 0), 6)) AS BIGINT) AS tokens,
      CAST(round(round(coalesce(active_seconds, 0), 6)) AS BIGINT) AS active_seconds, coalesce(n, 0) AS skill_calls FROM axis LEFT JOIN x USING (day, hour) LEFT JOIN sk USING (day, hour)""")
query("calendar_heat", lambda t: D.calendar_heat(_calendar(t), "2024-01-25"), f"""
    WITH {_CAL} SELECT day, round(6 + (cost_usd - min(cost_usd) OVER ()) / (max(cost_usd) OVER () - min(cost_usd) OVER ()) * 16, 6) AS heat_percent FROM cal WHERE day <= '2024-01-25'""")
query("period_totals", lambda t: D.period_totals(_calendar(t), "2024-01-25"), f"""
    WITH {_CAL} SELECT round(sum(cost_usd), 6) AS cost_usd, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(skill_calls) AS BIGINT) AS skill_calls,
      count(*) FILTER (cost_usd > 0 OR tokens > 0 OR sessions > 0 OR active_seconds >= 1 OR skill_calls > 0 OR subagent_calls > 0) AS active_days, count(*) AS elapsed_days
    FROM cal WHERE day <= '2024-01-25'""")


def _change(t):
    days = _calendar(t)
    return D.period_change(days.where("day >= '2024-01-16'"), days.where("day < '2024-01-16'"), "2024-01-25")


query("period_change", _change, f"""
    WITH {_CAL}, n AS (SELECT sum(cost_usd) AS c, CAST(sum(tokens) AS BIGINT) AS t, CAST(sum(skill_calls) AS BIGINT) AS s, count(*) AS e,
        count(*) FILTER (cost_usd > 0 OR tokens > 0 OR sessions > 0 OR active_seconds >= 1 OR skill_calls > 0 OR subagent_calls > 0) AS a
        FROM cal WHERE day >= '2024-01-16' AND day <= '2024-01-25'),
    p AS (SELECT sum(cost_usd) AS c, sum(tokens) AS t, sum(skill_calls) AS s FROM cal WHERE day < '2024-01-11')
    SELECT round(n.c, 6) AS cost_usd, n.t AS tokens, n.s AS skill_calls, n.a AS active_days, n.e AS elapsed_days, round((n.c - p.c) / p.c * 100, 6) AS cost_usd_change_percent,
      round((n.t - p.t) / p.t * 100, 6) AS tokens_change_percent, round(CASE WHEN p.s > 0 THEN (n.s - p.s) / p.s * 100 END, 6) AS skill_calls_change_percent FROM n, p""")

CUT = utc("2024-01-30")
_DORM = """dorm AS (SELECT sid FROM (SELECT sid, ts FROM points UNION ALL SELECT sid, ts FROM logs UNION ALL SELECT sid, st FROM spans) GROUP BY sid HAVING max(ts) < TIMESTAMP '2024-01-30'),
    newest AS (SELECT arg_max(id, (ts, id)) AS id FROM points GROUP BY stream)"""
query("dormant_sessions", lambda t: O.dormant_sessions(t.logs, t.points, t.spans, CUT), f"WITH {_DORM} SELECT sid AS session_id FROM dorm")
_GONE = "t.{c} < TIMESTAMP '2024-01-30' AND t.sid IN (SELECT sid FROM dorm)"
query("purge_preview", lambda t: O.purge_preview(t.logs, t.points, t.spans, CUT, {"log_records": 10_000_000, "metric_points": 5_000_000, "spans": 7_000_000}), f"""
    WITH {_DORM}, c AS (
      SELECT 'log_records' AS n, 10000000 AS b, count(*) FILTER (ts < TIMESTAMP '2024-01-30') AS o, count(*) FILTER ({_GONE.format(c='ts')}) AS g, count(*) AS a FROM logs t
      UNION ALL SELECT 'metric_points', 5000000, count(*) FILTER (ts < TIMESTAMP '2024-01-30'), count(*) FILTER ({_GONE.format(c='ts')} AND t.id NOT IN (SELECT id FROM newest)), count(*) FROM points t
      UNION ALL SELECT 'spans', 7000000, count(*) FILTER (st < TIMESTAMP '2024-01-30'), count(*) FILTER ({_GONE.format(c='st')}), count(*) FROM spans t)
    SELECT n AS table_name, o AS rows_older, g AS rows_to_delete, o - g AS preserved_rows, a AS total_rows, CAST(floor(b * g / a) AS BIGINT) AS estimated_bytes FROM c""")
query("purge_kept_points", lambda t: O.purge(t.logs, t.points, t.spans, CUT)["metric_points"].select("id", "metric_name", "session_id"), f"""
    WITH {_DORM} SELECT id, metric AS metric_name, sid AS session_id FROM points t WHERE NOT ({_GONE.format(c='ts')} AND t.id NOT IN (SELECT id FROM newest))""")
for _name, _key, _time in (("logs", "log_records", "ts"), ("spans", "spans", "st")):
    query(f"purge_kept_{_name}", lambda t, key=_key: O.purge(t.logs, t.points, t.spans, CUT)[key].select("id", "session_id"), f"""
        WITH {_DORM} SELECT id, sid AS session_id FROM {_name} t WHERE NOT ({_GONE.format(c=_time)})""")
query("row_statistics", lambda t: O.row_statistics(t.logs, t.points, t.spans, CUT), """
    SELECT 'log_records' AS table_name, count(*) AS row_count, epoch_us(min(ts)) AS oldest_timestamp, epoch_us(max(ts)) AS newest_timestamp, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS rows_in_window FROM logs
    UNION ALL SELECT 'metric_points', count(*), epoch_us(min(ts)), epoch_us(max(ts)), count(*) FILTER (ts >= TIMESTAMP '2024-01-30') FROM points
    UNION ALL SELECT 'spans', count(*), epoch_us(min(st)), epoch_us(max(st)), count(*) FILTER (st >= TIMESTAMP '2024-01-30') FROM spans""")
_HL = """SELECT '{s}' AS signal, epoch_us(max({c})) AS newest_timestamp, epoch_us(max({c})) AS newest_received_at, count(*) FILTER ({c} >= TIMESTAMP '2024-01-30 23:00:00') AS rows_last_hour,
    count(*) FILTER ({c} >= TIMESTAMP '2024-01-30') AS rows_last_day, count(*) FILTER ({c} >= TIMESTAMP '2024-01-24') AS rows_last_week,
    count(DISTINCT {n}) AS name_cardinality, {x} AS series_cardinality,
    CASE WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max({c})) <= 900000000 THEN 'live' WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max({c})) <= 86400000000 THEN 'delayed' ELSE 'stale' END AS freshness FROM {t}"""
query("ingest_health", lambda t: O.ingest_health(t.logs, t.points, t.spans, utc("2024-01-31")), " UNION ALL ".join([
    _HL.format(s="logs", c="ts", n="en", x="CAST(NULL AS BIGINT)", t="logs"), _HL.format(s="metrics", c="ts", n="metric", x="count(DISTINCT stream)", t="points"),
    _HL.format(s="traces", c="st", n="name", x="CAST(NULL AS BIGINT)", t="spans")]))
query("repository_usage", lambda t: O.repository_usage(t.logs, t.points, t.spans), """
    SELECT repo AS repository_url, epoch_us(max(ts)) AS last_seen, count(*) AS row_count FROM (SELECT repo, ts FROM logs UNION ALL SELECT repo, ts FROM points UNION ALL SELECT repo, st FROM spans)
    WHERE repo IS NOT NULL GROUP BY repo""")
query("growth_estimate", lambda t: O.growth_estimate(O.row_statistics(t.logs, t.points, t.spans, utc("2024-01-24")),
                                                     {"log_records": 10_000_000, "metric_points": 5_000_000, "spans": 7_000_000}, 100_000_000), """
    WITH s AS (SELECT 'log_records' AS n, 10000000 AS b, count(*) AS c, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS w, epoch_us(max(ts)) - epoch_us(min(ts)) AS h FROM logs
      UNION ALL SELECT 'metric_points', 5000000, count(*), count(*) FILTER (ts >= TIMESTAMP '2024-01-24'), epoch_us(max(ts)) - epoch_us(min(ts)) FROM points
      UNION ALL SELECT 'spans', 7000000, count(*), count(*) FILTER (st >= TIMESTAMP '2024-01-24'), epoch_us(max(st)) - epoch_us(min(st)) FROM spans),
    g AS (SELECT n AS table_name, CAST(b AS BIGINT) AS table_bytes, CAST(floor(b / c * w / 7) AS BIGINT) AS estimated_bytes_per_day, CAST(floor(h / 86400e6) AS BIGINT) AS retention_span_days FROM s)
    SELECT *, CAST(round((100000000 - sum(table_bytes) OVER ()) / sum(estimated_bytes_per_day) OVER ()) AS BIGINT) AS days_until_target FROM g""")
