"""Checkable queries: sessions and turns."""

from spanloom.catalog.base import CP, W, query
from spanloom.config import utc
from spanloom.operators import pages as G
from spanloom.operators import sessions as N
from spanloom.operators import turns as U
from pyspark.sql import functions as F

from spanloom.sources.summaries import Summaries

_TK = """CAST(coalesce(sum(d) FILTER (metric LIKE '%token%' AND tt = 'input' {w}), 0) AS BIGINT) AS input_tokens,
    CAST(coalesce(sum(d) FILTER (metric LIKE '%token%' AND tt = 'output' {w}), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(d) FILTER (metric LIKE '%token%' AND tt = 'cacheCreation' {w}), 0) AS BIGINT) AS cache_creation_tokens,
    CAST(coalesce(sum(d) FILTER (metric LIKE '%token%' AND tt = 'cacheRead' {w}), 0) AS BIGINT) AS cache_read_tokens"""
_LATE = "AND ts >= TIMESTAMP '2024-01-16'"
_FACTS = f"""WITH life AS (
      SELECT sid, sum(d) FILTER (metric LIKE '%cost%') AS cost, sum(d) FILTER (metric LIKE '%active%') AS act,
        min(ts) FILTER (metric LIKE '%cost%' OR metric LIKE '%active%') AS fs, max(ts) FILTER (metric LIKE '%cost%' OR metric LIKE '%active%') AS ls,
        count(*) FILTER ((metric LIKE '%cost%' OR metric LIKE '%active%') {_LATE}) AS n, {_TK.format(w=_LATE)}
      FROM moving GROUP BY sid),
    meta AS (SELECT sid, start_type, terminal FROM points WHERE metric LIKE '%session%' {_LATE}
             QUALIFY row_number() OVER (PARTITION BY sid ORDER BY ts, id) = 1),
    f AS (SELECT sid AS session_id, coalesce(cost, 0) AS cost_usd, coalesce(act, 0) AS active_time_seconds, fs AS first_seen, ls AS last_seen,
        input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
        CAST(floor((epoch_us(ls) - epoch_us(fs)) / 1e6 + 0.5) AS BIGINT) AS wall_seconds, start_type, terminal AS terminal_type
      FROM life LEFT JOIN meta USING (sid) WHERE n > 0)
    SELECT session_id, round(cost_usd, 6) AS cost_usd, round(active_time_seconds, 6) AS active_time_seconds, epoch_us(first_seen) AS first_seen,
      epoch_us(last_seen) AS last_seen, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, wall_seconds, start_type, terminal_type,
      (SELECT count(*) FROM f) AS total_count FROM f ORDER BY """
_ORD = {
    "cost": "round(cost_usd, 9)", "active": "round(active_time_seconds, 9)", "wall": "wall_seconds",
    "tokens": "input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens",
    "cacheEfficiency": """CASE WHEN input_tokens + cache_creation_tokens + cache_read_tokens > 0
        THEN cache_read_tokens / (input_tokens + cache_creation_tokens + cache_read_tokens) END""",
    "costPerMinute": "CASE WHEN active_time_seconds > 0 THEN round(cost_usd / active_time_seconds * 60, 9) END",
    "started": "f.first_seen", "ended": "f.last_seen",
}
for _key, _sql in _ORD.items():
    for _desc in (True, False):
        _dir = "DESC" if _desc else "ASC"
        query(f"session_summaries_{_key.lower()}_{_dir.lower()}",
              lambda t, k=_key, d=_desc: N.session_summaries(t.points, CP, k, d, page=1, size=40, kept=t.kept),
              f"{_FACTS} {_sql} {_dir} NULLS LAST, session_id LIMIT 40 OFFSET 40")

_NOW = "2024-01-29 12:00:00"
query("session_page", lambda t: G.session_page(t.points, t.logs, _open(t.spans), CP, utc(_NOW), size=100_000, kept=Summaries.of(t.points, _open(t.spans), t.logs)), f"""
    WITH {_FACTS[5:_FACTS.index("SELECT session_id, round(cost_usd")]},
    s AS (SELECT * FROM spans WHERE NOT (name = 'claude_code.interaction' AND CAST(substr(sid, 2) AS BIGINT) % 2 = 1)),
    c AS (SELECT sid, count(*) FILTER (en = 'tool_result') AS tc, count(*) FILTER (decision = 'reject') AS dc, count(*) FILTER (en = 'user_prompt') AS pc,
      regexp_replace(first(prompt ORDER BY ts, id) FILTER (en = 'user_prompt'), '\\s+', ' ', 'g') AS fp FROM logs GROUP BY sid),
    p AS (SELECT sid, tr FROM logs WHERE en = 'user_prompt' QUALIFY row_number() OVER (PARTITION BY sid ORDER BY ts DESC, id DESC) = 1),
    a AS (SELECT tr, max(x) AS x FROM (SELECT tr, et AS x FROM s UNION ALL SELECT tr, ts FROM logs) GROUP BY tr),
    live AS (SELECT p.sid FROM p JOIN a USING (tr) WHERE a.x > TIMESTAMP '{_NOW}' - INTERVAL 20 MINUTE AND NOT EXISTS (SELECT 1 FROM s WHERE s.tr = p.tr AND s.parent IS NULL)
      UNION SELECT l.sid FROM logs l JOIN s ON s.tr = l.tr AND s.parent IS NULL WHERE l.ts > TIMESTAMP '{_NOW}' - INTERVAL 2 MINUTE AND epoch_us(l.ts) > epoch_us(s.et) + 5000000)
    SELECT session_id, round(cost_usd, 6) AS cost_usd, round(active_time_seconds, 6) AS active_time_seconds, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen,
      input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, wall_seconds, CASE WHEN start_type = 'resume' THEN 'resume' ELSE 'fresh' END AS start_type,
      CASE WHEN terminal_type = 'interactive' THEN 'interactive' ELSE 'non-interactive' END AS terminal_type, (SELECT count(*) FROM f) AS total_count,
      coalesce(tc, 0) AS tool_call_count, coalesce(dc, 0) AS denial_count, coalesce(pc, 0) AS user_prompt_count, fp AS first_user_prompt,
      session_id IN (SELECT sid FROM live) AS in_progress, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS tokens FROM f LEFT JOIN c ON c.sid = f.session_id""")

_FIRST = "regexp_replace(first(prompt ORDER BY ts, id) FILTER (en = 'user_prompt'), '\\s+', ' ', 'g')"
query("session_counts", lambda t: N.session_counts(t.logs), f"""
    SELECT sid AS session_id, count(*) FILTER (en = 'tool_result') AS tool_call_count, count(*) FILTER (decision = 'reject') AS denial_count,
      count(*) FILTER (en = 'user_prompt') AS user_prompt_count, {_FIRST} AS first_user_prompt FROM logs GROUP BY sid""")
query("first_prompts", lambda t: N.first_prompts(t.logs), f"""
    SELECT sid AS session_id, {_FIRST} AS first_user_prompt FROM logs WHERE en = 'user_prompt' GROUP BY sid""")
query("session_kpis", lambda t: N.session_kpis(t.points, W), """
    WITH p AS (SELECT sid, coalesce(sum(d) FILTER (metric LIKE '%cost%'), 0) AS c, coalesce(sum(d) FILTER (metric LIKE '%active%'), 0) AS a
               FROM moving WHERE metric LIKE '%cost%' OR metric LIKE '%active%' GROUP BY sid)
    SELECT count(*) AS total_sessions, round(quantile_cont(c, 0.5), 6) AS median_cost_usd, round(quantile_cont(c, 0.95), 6) AS p95_cost_usd,
           round(quantile_cont(c / a * 60, 0.5) FILTER (a > 0), 6) AS median_cost_per_active_minute_usd FROM p""")
query("new_sessions_trend", lambda t: N.new_sessions_trend(t.points, W, bins=30, kept=t.kept), """
    WITH f AS (SELECT sid, min(ts) AS t FROM points WHERE metric LIKE '%cost%' OR metric LIKE '%active%' GROUP BY sid HAVING count(*) FILTER (d <> 0) > 0),
    axis AS (SELECT i FROM range(30) r(i))
    SELECT i AS bucket_index, count(f.sid) AS new_sessions FROM axis LEFT JOIN f ON (epoch_us(f.t) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 = i GROUP BY i""")
query("worst_cache_sessions", lambda t: N.worst_cache_sessions(t.points, W, min_tokens=2000, kept=t.kept), f"""
    WITH p AS (SELECT sid, sum(d) FILTER (metric LIKE '%cost%') AS c, max(ts) FILTER (metric LIKE '%cost%' OR metric LIKE '%active%') AS ls,
        count(*) FILTER (metric LIKE '%token%') AS nt, count(*) FILTER (metric LIKE '%cost%' OR metric LIKE '%active%') AS nc, {_TK.format(w='')} FROM moving GROUP BY sid),
    e AS (SELECT *, input_tokens + cache_creation_tokens + cache_read_tokens AS side FROM p WHERE nt > 0 AND nc > 0)
    SELECT sid AS session_id, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, round(c, 6) AS cost_usd, epoch_us(ls) AS last_seen,
      side AS input_side_tokens, round(cache_read_tokens / side, 6) AS cache_efficiency,
      CASE WHEN cache_read_tokens / side >= 0.85 THEN 'strong' WHEN cache_read_tokens / side >= 0.6 THEN 'mixed' ELSE 'weak' END AS band
    FROM e WHERE side >= 2000 ORDER BY cache_read_tokens / side, side DESC, sid LIMIT 8""")

# Every test trace has a closed root, so the span side here leaves the roots of odd sessions out.
_OPEN_ROOTS = "NOT (name = 'claude_code.interaction' AND CAST(substr(sid, 2) AS BIGINT) % 2 = 1)"


def _open(spans):
    odd = (F.col("name") == "claude_code.interaction") & (F.substring("session_id", 2, 20).cast("long") % 2 == 1)
    return spans.where(~odd)


query("in_progress_sessions", lambda t: N.in_progress_sessions(t.logs, _open(t.spans), utc("2024-01-10")), f"""
    WITH s AS (SELECT * FROM spans WHERE {_OPEN_ROOTS}),
    p AS (SELECT sid, tr FROM logs WHERE en = 'user_prompt' QUALIFY row_number() OVER (PARTITION BY sid ORDER BY ts DESC, id DESC) = 1),
    a AS (SELECT tr, max(x) AS x FROM (SELECT tr, et AS x FROM s UNION ALL SELECT tr, ts FROM logs) GROUP BY tr)
    SELECT DISTINCT p.sid AS session_id FROM p JOIN a USING (tr) WHERE a.x > TIMESTAMP '2024-01-10'
      AND NOT EXISTS (SELECT 1 FROM s WHERE s.tr = p.tr AND s.parent IS NULL)""")
query("background_active", lambda t: N.background_active(t.logs, t.spans, utc("2024-01-02"), kept=t.kept), """
    SELECT DISTINCT l.sid AS session_id, l.tr AS trace_id FROM logs l JOIN spans s ON s.tr = l.tr AND s.parent IS NULL
    WHERE l.ts > TIMESTAMP '2024-01-02' AND epoch_us(l.ts) > epoch_us(s.et) + 5000000""")
query("turn_progress", lambda t: N.turn_progress(_open(t.spans), t.logs), f"""
    WITH s AS (SELECT * FROM spans WHERE {_OPEN_ROOTS}), a AS (SELECT tr, max(x) AS x FROM (SELECT tr, et AS x FROM s UNION ALL SELECT tr, ts FROM logs) GROUP BY tr)
    SELECT a.tr AS trace_id, coalesce(count(s.sp) FILTER (s.parent IS NULL), 0) > 0 AS root_closed, epoch_us(a.x) AS last_activity
    FROM a LEFT JOIN s USING (tr) GROUP BY a.tr, a.x""")

_TURNS = """turns AS (SELECT sid, ts, id, prompt, tr, pid, row_number() OVER (PARTITION BY sid ORDER BY ts, id) AS n FROM logs WHERE en = 'user_prompt')"""
query("session_turns", lambda t: U.turns(t.logs), f"""
    WITH {_TURNS} SELECT sid AS session_id, epoch_us(ts) AS turn_ts, id, prompt AS prompt_text, tr AS trace_id, pid AS prompt_id, n AS turn_no FROM turns""")
query("request_turns", lambda t: U.request_turns(t.logs), """
    WITH m AS (SELECT sid, pid, model FROM logs WHERE en = 'api_request' GROUP BY 1, 2, 3
               QUALIFY row_number() OVER (PARTITION BY sid, pid ORDER BY count(*) DESC, model) = 1)
    SELECT sid AS session_id, pid AS prompt_id, count(*) AS request_count, CAST(sum(ti) AS BIGINT) AS input_tokens, CAST(sum(tou) AS BIGINT) AS output_tokens,
      CAST(sum(tcc) AS BIGINT) AS cache_creation_tokens, CAST(sum(tcr) AS BIGINT) AS cache_read_tokens, round(CAST(sum(cost) AS DOUBLE), 6) AS cost_usd,
      CAST(sum(ms) AS BIGINT) AS duration_ms, any_value(m.model) AS model
    FROM logs l JOIN m USING (sid, pid) WHERE en = 'api_request' GROUP BY 1, 2""")
query("session_requests", lambda t: U.session_requests(t.logs), """
    SELECT sid AS session_id, rid AS request_id, epoch_us(ts) AS request_timestamp, id, pid AS prompt_id, model, ti AS input_tokens, tou AS output_tokens,
      tcc AS cache_creation_tokens, tcr AS cache_read_tokens, round(CAST(cost AS DOUBLE), 6) AS cost_usd, CAST(ms AS BIGINT) AS duration_ms, effort,
      CAST(NULL AS VARCHAR) AS speed, tr AS trace_id FROM logs WHERE en = 'api_request'""")
query("session_cost_points", lambda t: U.cost_points_of(t.points), """
    SELECT sid AS session_id, epoch_us(ts) AS timestamp, id, round(d, 6) AS value_delta FROM points WHERE metric LIKE '%cost%'""")
query("session_token_points", lambda t: U.token_points_of(t.points), """
    SELECT sid AS session_id, epoch_us(ts) AS timestamp, id, model, tt AS token_type, round(d, 6) AS value_delta FROM points WHERE metric LIKE '%token%'""")
query("session_tool_events", lambda t: U.tool_events(t.logs), """
    SELECT sid AS session_id, epoch_us(ts) AS timestamp, id, tn AS tool_name FROM logs WHERE en = 'tool_result'""")
query("assign_turn", lambda t: U.assign_turn(U.tool_events(t.logs), U.turns(t.logs)), f"""
    WITH {_TURNS} SELECT l.sid AS session_id, epoch_us(l.ts) AS timestamp, l.id, l.tn AS tool_name, turns.n AS turn_no
    FROM (SELECT * FROM logs WHERE en = 'tool_result') l ASOF JOIN turns ON turns.sid = l.sid AND turns.ts <= l.ts""")
_ENDS = "ends AS (SELECT tr, max(et) AS e FROM spans WHERE parent IS NULL GROUP BY tr)"
_SPLITC = f"""SELECT l.tr, CAST(sum(cost) AS DOUBLE) AS total, coalesce(CAST(sum(cost) FILTER (l.ts > e) AS DOUBLE), 0) AS bg
    FROM logs l LEFT JOIN ends USING (tr) WHERE en = 'api_request' GROUP BY l.tr"""
query("cost_split_by_trace", lambda t: U.cost_split_by_trace(t.logs, t.spans), f"""
    WITH {_ENDS}, c AS ({_SPLITC}) SELECT tr AS trace_id, round(total, 6) AS total_cost_usd, round(bg, 6) AS background_cost_usd FROM c""")
query("tool_split_by_trace", lambda t: U.tool_split_by_trace(t.logs, t.spans), f"""
    WITH {_ENDS} SELECT l.tr AS trace_id, l.tn AS tool_name, count(*) FILTER (e IS NULL OR l.ts <= e) AS own_count,
      count(*) FILTER (e IS NOT NULL AND l.ts > e) AS background_count FROM logs l LEFT JOIN ends USING (tr) WHERE en = 'tool_result' GROUP BY 1, 2""")
_SPLITT = """SELECT tr, CAST(sum(ti) AS BIGINT) AS input_tokens, CAST(sum(tou) AS BIGINT) AS output_tokens,
    CAST(sum(tcc) AS BIGINT) AS cache_creation_tokens, CAST(sum(tcr) AS BIGINT) AS cache_read_tokens FROM logs WHERE en = 'api_request' GROUP BY tr"""
query("token_split_by_trace", lambda t: U.token_split_by_trace(t.logs), f"WITH x AS ({_SPLITT}) SELECT tr AS trace_id, * EXCLUDE (tr) FROM x")
_MODELT = """SELECT tr, model FROM logs WHERE en = 'api_request' GROUP BY tr, model QUALIFY row_number() OVER (PARTITION BY tr ORDER BY count(*) DESC, model) = 1"""
query("model_by_trace", lambda t: U.model_by_trace(t.logs), f"WITH x AS ({_MODELT}) SELECT tr AS trace_id, model FROM x")
query("prompt_tools", lambda t: U.prompt_tools(U.turns(t.logs), t.logs, t.spans), f"""
    WITH {_TURNS}, {_ENDS}, firsts AS (SELECT sid, tr, min(n) AS n FROM turns GROUP BY 1, 2),
    byt AS (SELECT tr, tn, count(*) AS calls, count(*) FILTER (l.ts > e) AS bg FROM logs l LEFT JOIN ends USING (tr) WHERE en = 'tool_result' GROUP BY 1, 2),
    byi AS (SELECT l.sid, turns.n, l.tn, count(*) AS calls FROM (SELECT * FROM logs WHERE en = 'tool_result') l
            ASOF JOIN turns ON turns.sid = l.sid AND turns.ts <= l.ts GROUP BY 1, 2, 3)
    SELECT sid AS session_id, n AS turn_no, tn AS tool_name, calls, bg AS background_calls FROM firsts JOIN byt USING (tr)
    UNION ALL SELECT sid, n, tn, calls, 0 FROM byi WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.sid = byi.sid AND f.n = byi.n)""")
query("prompt_timeline", lambda t: U.prompt_timeline(t.logs, t.points, t.spans), f"""
    WITH {_TURNS}, {_ENDS}, firsts AS (SELECT sid, tr, min(n) AS n FROM turns GROUP BY 1, 2),
    cs AS ({_SPLITC}), tk AS ({_SPLITT}), md AS ({_MODELT}),
    ic AS (SELECT p.sid, turns.n, sum(p.d) AS c FROM (SELECT * FROM points WHERE metric LIKE '%cost%') p ASOF JOIN turns ON turns.sid = p.sid AND turns.ts <= p.ts GROUP BY 1, 2),
    it AS (SELECT p.sid, turns.n, p.model, p.tt, p.d FROM (SELECT * FROM points WHERE metric LIKE '%token%') p ASOF JOIN turns ON turns.sid = p.sid AND turns.ts <= p.ts),
    itk AS (SELECT sid, n, {', '.join(f"CAST(coalesce(sum(d) FILTER (tt = '{k}'), 0) AS BIGINT) AS {c}" for c, k in (('a', 'input'), ('b', 'output'), ('c', 'cacheCreation'), ('e', 'cacheRead')))} FROM it GROUP BY 1, 2),
    itm AS (SELECT sid, n, model FROM it GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY sid, n ORDER BY sum(d) DESC, model DESC) = 1),
    rm AS (SELECT sid, pid, model FROM logs WHERE en = 'api_request' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY sid, pid ORDER BY count(*) DESC, model) = 1),
    rq AS (SELECT sid, pid, count(*) AS rc, CAST(sum(ti) AS BIGINT) AS a, CAST(sum(tou) AS BIGINT) AS b, CAST(sum(tcc) AS BIGINT) AS c, CAST(sum(tcr) AS BIGINT) AS e,
             CAST(sum(cost) AS DOUBLE) AS usd, any_value(rm.model) AS model FROM logs l JOIN rm USING (sid, pid) WHERE en = 'api_request' GROUP BY 1, 2)
    SELECT t.sid AS session_id, t.n AS turn_no, epoch_us(t.ts) AS turn_ts, t.tr AS trace_id, t.pid AS prompt_id,
      CASE WHEN rc IS NOT NULL THEN 'REQUEST' ELSE 'INTERVAL' END AS attribution, coalesce(rc, 0) AS request_count,
      coalesce(CASE WHEN f.n IS NOT NULL THEN md.model END, CASE WHEN rc IS NOT NULL THEN rq.model ELSE itm.model END) AS model,
      round(coalesce(CASE WHEN f.n IS NOT NULL THEN cs.total END, CASE WHEN f.n IS NULL AND cs.tr IS NOT NULL THEN NULL ELSE ic.c END, rq.usd), 6) AS cost_usd,
      round(CASE WHEN f.n IS NOT NULL AND cs.bg > 0 THEN cs.bg END, 6) AS background_cost_usd,
      coalesce(CASE WHEN f.n IS NOT NULL THEN tk.input_tokens END, CASE WHEN rc IS NOT NULL THEN rq.a ELSE itk.a END) AS input_tokens,
      coalesce(CASE WHEN f.n IS NOT NULL THEN tk.output_tokens END, CASE WHEN rc IS NOT NULL THEN rq.b ELSE itk.b END) AS output_tokens,
      coalesce(CASE WHEN f.n IS NOT NULL THEN tk.cache_creation_tokens END, CASE WHEN rc IS NOT NULL THEN rq.c ELSE itk.c END) AS cache_creation_tokens,
      coalesce(CASE WHEN f.n IS NOT NULL THEN tk.cache_read_tokens END, CASE WHEN rc IS NOT NULL THEN rq.e ELSE itk.e END) AS cache_read_tokens,
      CAST(NULL AS VARCHAR) AS dispatching_trace_id
    FROM turns t LEFT JOIN firsts f ON f.sid = t.sid AND f.n = t.n LEFT JOIN cs ON cs.tr = t.tr LEFT JOIN tk ON tk.tr = t.tr LEFT JOIN md ON md.tr = t.tr
    LEFT JOIN ic ON ic.sid = t.sid AND ic.n = t.n LEFT JOIN itk ON itk.sid = t.sid AND itk.n = t.n LEFT JOIN itm ON itm.sid = t.sid AND itm.n = t.n
    LEFT JOIN rq ON rq.sid = t.sid AND rq.pid = t.pid""")


# The test prompts are no notifications. Here they all become notifications of an
# earlier call, in one session, which is also the skewed case.
def _one_session(logs):
    return logs.withColumn("session_id", F.lit("s"))


def _notified_one(t):
    logs = _one_session(t.logs)
    note = F.concat(F.lit("  <task-notification><tool-use-id>c"), F.greatest(F.col("id") - 37, F.lit(0)).cast("string"),
                    F.lit("</tool-use-id></task-notification>"))
    return U.turns(logs).withColumn("prompt_text", note), logs


query("dispatched_turns", lambda t: U.dispatched_turns(*_notified_one(t)), """
    WITH turns AS (SELECT id, ts, tr, 'c' || greatest(id - 37, 0) AS tuid, row_number() OVER (ORDER BY ts, id) AS n FROM logs WHERE en = 'user_prompt')
    SELECT 's' AS session_id, t.n AS turn_no, l.tr AS dispatching_trace_id FROM turns t JOIN logs l ON l.en = 'tool_result' AND l.tuid = t.tuid
    WHERE l.tr <> t.tr AND l.ts < (SELECT max(ts) FROM turns)""")


def _nested(t):
    rows, logs = _notified_one(t)
    found = U.dispatched_turns(rows, logs)
    nested = U.nest_turns(rows.join(found, ["session_id", "turn_no"], "left"))
    return nested.select("turn_no", "parent_no", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


query("nest_turns", _nested, """
    WITH RECURSIVE turns AS (SELECT id, ts, tr, 'c' || greatest(id - 37, 0) AS tuid, row_number() OVER (ORDER BY ts, id) AS n FROM logs WHERE en = 'user_prompt'),
    firsts AS (SELECT tr, min(n) AS n FROM turns GROUP BY tr),
    link AS (SELECT t.n, CASE WHEN f.n < t.n AND l.tr <> t.tr THEN f.n END AS p FROM turns t
             LEFT JOIN logs l ON l.en = 'tool_result' AND l.tuid = t.tuid AND l.ts < (SELECT max(ts) FROM turns) LEFT JOIN firsts f ON f.tr = l.tr),
    walk AS (SELECT n, p, CAST(0 AS BIGINT) AS depth, CAST(n AS VARCHAR) AS path FROM link WHERE p IS NULL
             UNION ALL SELECT l.n, l.p, w.depth + 1, w.path || '/' || l.n FROM link l JOIN walk w ON l.p = w.n)
    SELECT n AS turn_no, p AS parent_no, depth, path FROM walk""")
