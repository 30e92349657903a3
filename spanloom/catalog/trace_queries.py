"""Checkable queries: traces, span trees, findings, log correlation."""

from dataclasses import replace

from pyspark.sql import functions as F

from spanloom.catalog.base import DAY, W, query
from spanloom.catalog.explore import _execution
from spanloom.config import CFG, utc
from spanloom.operators import correlation as K
from spanloom.operators import pages as G
from spanloom.operators import span_tree as S
from spanloom.operators import trace_findings as X
from spanloom.operators import traces as T

_SUM = """sums AS (
      SELECT tr, min(st) AS min_start, max(et) AS max_end, count(*) AS span_count, count(*) FILTER (status = 'error') AS error_count,
        CAST(sum(ti + tou + tcc + tcr) AS BIGINT) AS total_tokens FROM spans {r} GROUP BY tr),
    roots AS (SELECT tr, sp AS root_span_id, name AS root_span_name, sid AS session_id FROM spans
              QUALIFY row_number() OVER (PARTITION BY tr ORDER BY parent IS NOT NULL, st, sp) = 1),
    costs AS (SELECT tr, sum(cost) AS usd FROM logs WHERE en = 'api_request' GROUP BY tr),
    traces0 AS (SELECT s.tr AS trace_id, min_start, max_end, span_count, error_count, total_tokens, root_span_id, root_span_name, session_id,
        coalesce(CAST(c.usd AS DECIMAL(38,12)), 0) AS total_cost_usd, (epoch_us(max_end) - epoch_us(min_start)) / 1000.0 AS duration_ms,
        CASE WHEN error_count > 0 THEN 'error' ELSE 'ok' END AS status, 'claude_code.session' AS service
      FROM sums s JOIN roots USING (tr) LEFT JOIN costs c USING (tr)),
    traces AS (SELECT *, CASE WHEN duration_ms < 100 THEN 'd0' WHEN duration_ms < 1000 THEN 'd1' WHEN duration_ms < 5000 THEN 'd2' ELSE 'd3' END AS duration_bucket FROM traces0)"""
_ALL = _SUM.format(r="")
_COLS = """trace_id, epoch_us(min_start) AS min_start, epoch_us(max_end) AS max_end, span_count, error_count, total_tokens, root_span_id, root_span_name, session_id,
    round(CAST(total_cost_usd AS DOUBLE), 6) AS total_cost_usd, round(duration_ms, 6) AS duration_ms, status, service, duration_bucket"""
query("trace_summaries", lambda t: T.trace_summaries(t.spans, t.logs, W, kept=t.kept), f"WITH {_ALL} SELECT {_COLS} FROM traces")
query("trace_summaries_repository", lambda t: T.trace_summaries(t.spans, t.logs, W, "repo1", t.kept),
      f"WITH {_SUM.format(r=chr(87) + 'HERE repo = ' + chr(39) + 'repo1' + chr(39))} SELECT {_COLS} FROM traces")

_FIL = T.TraceFilter(W, statuses=("error",), services=("claude_code.session",), text="T1")
_WHERE = "status = 'error' AND (trace_id ILIKE '%T1%' OR session_id ILIKE '%T1%' OR root_span_name ILIKE '%T1%')"
_CURSOR = "t25"


def _list(sort, mode):
    def build(t):
        cursor = T.trace_cursor_key(t.spans, t.logs, sort, _CURSOR) if mode in ("before", "after") else None
        return T.trace_list(t.spans, t.logs, sort, mode, _FIL if mode == "first" else T.TraceFilter(W), cursor, page=1, size=20, kept=t.kept)
    return build


for _sort, (_columns, _desc) in T.SORTS.items():
    for _mode in ("first", "before", "after", "offset"):
        _d = "DESC" if _desc else "ASC"
        _order = ", ".join(f"{c} {_d}" for c in _columns)
        _less = "<" if _desc == (_mode == "before") else ">"
        _key = f"(SELECT ({', '.join(_columns)}) FROM traces WHERE trace_id = '{_CURSOR}')"
        _row = f"({', '.join(_columns)})"
        if _mode == "first":
            _page = f"SELECT * FROM traces WHERE {_WHERE} ORDER BY {_order} LIMIT 21"
        elif _mode == "offset":
            _page = f"SELECT * FROM traces ORDER BY {_order} LIMIT 20 OFFSET 20"
        elif _mode == "after" and _sort == "old":
            _page = f"SELECT * FROM traces WHERE {_row} {_less} {_key} ORDER BY min_start DESC, trace_id DESC LIMIT 21"
        else:
            _page = f"SELECT * FROM traces WHERE {_row} {_less} {_key} ORDER BY {_order} LIMIT 21"
        query(f"trace_list_{_sort}_{_mode}", _list(_sort, _mode), f"WITH {_ALL}, page AS ({_page}) SELECT {_COLS} FROM page")

query("trace_page", lambda t: G.trace_page(t.spans, t.logs, utc("2024-01-29"), f=T.TraceFilter(W), size=100_000, kept=t.kept), f"""WITH {_ALL},
    ends AS (SELECT tr, max(et) AS root_end FROM spans WHERE parent IS NULL GROUP BY tr),
    late AS (SELECT l.tr, sum(l.cost) AS usd FROM logs l JOIN ends e ON e.tr = l.tr WHERE l.cost IS NOT NULL AND l.ts > e.root_end GROUP BY l.tr),
    said AS (SELECT tr, regexp_replace(first(prompt ORDER BY ts, id), '\\s+', ' ', 'g') AS prompt FROM logs WHERE en = 'user_prompt' GROUP BY tr)
    SELECT {_COLS}, prompt AS first_user_prompt, round(coalesce(CAST(late.usd AS DOUBLE), 0), 6) AS background_cost_usd, FALSE AS in_progress
    FROM traces LEFT JOIN late ON late.tr = trace_id LEFT JOIN said ON said.tr = trace_id""")
query("trace_page_running", lambda t: G.trace_page(_rootless(t.spans), t.logs, utc("2024-01-29"), f=T.TraceFilter(W), size=100_000)
      .select("trace_id", "in_progress"), """
    WITH s AS (SELECT * FROM spans WHERE NOT (parent IS NULL AND CAST(substr(sid, 2) AS BIGINT) % 2 = 1)),
    a AS (SELECT tr, max(x) AS x FROM (SELECT tr, et AS x FROM s UNION ALL SELECT tr, ts FROM logs) GROUP BY tr)
    SELECT DISTINCT s.tr AS trace_id, a.x > TIMESTAMP '2024-01-28 23:40:00' AND NOT EXISTS (SELECT 1 FROM s r WHERE r.tr = s.tr AND r.parent IS NULL) AS in_progress FROM s JOIN a USING (tr)""")
query("trace_count", lambda t: T.trace_count(t.spans, _FIL, t.kept), f"WITH {_ALL} SELECT count(*) AS row_count FROM traces WHERE {_WHERE}")
query("trace_histogram", lambda t: T.trace_histogram(t.spans, T.TraceFilter(W), DAY, t.kept), f"""
    WITH {_ALL}, axis AS (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS b FROM range(31) r(i))
    SELECT epoch_us(b) AS bucket, count(*) FILTER (status = 'ok') AS ok_count, count(*) FILTER (status = 'error') AS error_count,
      round(coalesce(quantile_cont(duration_ms, 0.95), 0), 6) AS p95_ms FROM axis LEFT JOIN traces ON date_trunc('day', min_start) = b GROUP BY b""")
query("trace_globals", lambda t: T.trace_globals(t.spans, T.TraceFilter(W), t.kept), f"""
    WITH {_ALL} SELECT count(*) AS total, count(*) FILTER (status = 'error') AS error_count, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms,
      round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM traces""")
query("trace_facets", lambda t: T.trace_facets(t.spans, T.TraceFilter(W, statuses=("error",), text="s1"), kept=t.kept), f"""
    WITH {_ALL}, f AS (SELECT * FROM traces WHERE trace_id ILIKE '%s1%' OR session_id ILIKE '%s1%' OR root_span_name ILIKE '%s1%'), e AS (SELECT * FROM f WHERE status = 'error')
    SELECT 'status' AS facet_kind, status AS facet_key, count(*) AS row_count FROM f GROUP BY 2
    UNION ALL SELECT 'operation', root_span_name, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM e GROUP BY 2
    UNION ALL SELECT 'duration_bucket', duration_bucket, count(*) FROM e GROUP BY 2
    UNION ALL (SELECT 'session', session_id, count(*) FROM e GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8)""")
query("trace_summary", lambda t: T.trace_summary(t.spans, t.logs, "t7"), f"WITH {_ALL} SELECT {_COLS} FROM traces WHERE trace_id = 't7'")
query("first_prompt_by_trace_whole", lambda t: T.first_prompt_by_trace(t.logs), """
    SELECT tr AS trace_id, regexp_replace(first(prompt ORDER BY ts, id), '\\s+', ' ', 'g') AS first_user_prompt FROM logs WHERE en = 'user_prompt' GROUP BY tr""")
query("first_prompt_by_trace", lambda t: T.first_prompt_by_trace(t.logs, 12), """
    SELECT tr AS trace_id, left(regexp_replace(first(prompt ORDER BY ts, id), '\\s+', ' ', 'g'), 12) AS first_user_prompt FROM logs WHERE en = 'user_prompt' GROUP BY tr""")


def _rootless(spans):
    return spans.where(~(F.col("parent_span_id").isNull() & (F.substring("session_id", 2, 20).cast("long") % 2 == 1)))


_RL = "s AS (SELECT * FROM spans WHERE NOT (parent IS NULL AND CAST(substr(sid, 2) AS BIGINT) % 2 = 1))"
query("in_progress_traces", lambda t: T.in_progress_traces(_rootless(t.spans), t.logs, utc("2024-01-10")), f"""
    WITH {_RL}, a AS (SELECT tr, max(x) AS x FROM (SELECT tr, et AS x FROM s UNION ALL SELECT tr, ts FROM logs) GROUP BY tr)
    SELECT DISTINCT a.tr AS trace_id FROM a JOIN s USING (tr) WHERE x > TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM s r WHERE r.tr = a.tr AND r.parent IS NULL)""")
query("trace_latest_end", lambda t: T.trace_latest_end(t.spans), "SELECT tr AS trace_id, epoch_us(max(et)) AS latest_end FROM spans GROUP BY tr")

# Ids grow with time in the test data, so a list of ids orders like a path.
_TREE = """tree AS (SELECT tr, sp, id, parent, CAST(0 AS BIGINT) AS depth, [id] AS path FROM spans WHERE parent IS NULL
    UNION ALL SELECT s.tr, s.sp, s.id, s.parent, t.depth + 1, list_append(t.path, s.id) FROM spans s JOIN tree t ON s.tr = t.tr AND s.parent = t.sp)"""
_CALLS = """calls AS (SELECT *, row_number() OVER (PARTITION BY tr ORDER BY st, sp) AS n FROM spans WHERE name IN ('claude_code.tool', 'claude_code.llm_request')),
    above AS (SELECT c.tr, c.sp, u.aid FROM calls c JOIN tree t ON t.id = c.id, unnest(t.path[1:len(t.path) - 1]) u(aid)),
    chains AS (SELECT a.tr, a.sp, list(d.n ORDER BY d.id) AS chain FROM above a JOIN calls d ON d.id = a.aid AND d.name = 'claude_code.tool' AND d.tn = 'Agent' GROUP BY 1, 2),
    ac AS (SELECT c.*, chain[-1] AS dno, coalesce(array_to_string(chain, '>'), 'main') AS branch FROM calls c LEFT JOIN chains USING (tr, sp)),
    pc AS (SELECT ac.*, coalesce(CAST(q.cost AS DOUBLE), 0) AS usd, q.qs, CASE WHEN dno IS NOT NULL THEN 'subagent' WHEN q.qs = 'compact' THEN 'auxiliary' ELSE 'main' END AS unit,
             ac.name = 'claude_code.llm_request' AS is_model FROM ac LEFT JOIN logs q ON q.en = 'api_request' AND q.rid = ac.rid)"""
_TC = f"WITH RECURSIVE {_TREE}, {_CALLS}"
query("span_tree", lambda t: S.span_tree(t.spans).withColumn("ancestry", F.array_join("ancestry", "/")), f"""
    WITH RECURSIVE {_TREE} SELECT tr AS trace_id, sp AS span_id, parent AS parent_span_id, depth, row_number() OVER (PARTITION BY tr ORDER BY path) AS preorder,
      array_to_string(list_transform(path, lambda x: 'e' || x), '/') AS ancestry FROM tree""")
query("call_numbers", lambda t: S.call_numbers(t.spans).select("trace_id", "span_id", "call_no"), f"{_TC} SELECT tr AS trace_id, sp AS span_id, n AS call_no FROM calls")
query("dispatch_chain", lambda t: S.dispatch_chain(t.spans), f"{_TC} SELECT tr AS trace_id, sp AS span_id, n AS call_no, branch, dno AS dispatch_no FROM ac")
query("trace_cost_breakdown", lambda t: S.trace_cost_breakdown(t.spans, t.logs), f"""{_TC},
    s AS (SELECT tr, unit, dno, sum(usd) AS usd, count(*) FILTER (is_model) AS m, count(*) FILTER (NOT is_model) AS c,
            first(substr(qs, 7) ORDER BY n) FILTER (is_model AND qs LIKE 'agent:%') AS label FROM pc WHERE is_model OR dno IS NOT NULL GROUP BY 1, 2, 3),
    d AS (SELECT tr, n AS dno FROM calls WHERE name = 'claude_code.tool' AND tn = 'Agent')
    SELECT tr AS trace_id, unit, dno AS dispatch_no, round(usd, 6) AS cost_usd, m AS model_calls, c AS tool_calls, CAST(NULL AS VARCHAR) AS label FROM s WHERE unit <> 'subagent'
    UNION ALL SELECT d.tr, 'subagent', d.dno, round(coalesce(usd, 0), 6), coalesce(m, 0), coalesce(c, 0), coalesce(label, 'subagent') FROM d LEFT JOIN s ON s.tr = d.tr AND s.dno = d.dno AND s.unit = 'subagent'""")
query("trace_cost_totals", lambda t: S.trace_cost_totals(t.spans, t.logs), f"""{_TC}
    SELECT tr AS trace_id, round(sum(usd), 6) AS measured_usd, count(*) AS model_calls, CASE WHEN max(usd) > 0 THEN first(n ORDER BY usd DESC, n) END AS costliest_call,
      round(max(usd), 6) AS costliest_usd FROM pc WHERE is_model GROUP BY tr""")
query("time_attribution", lambda t: S.time_attribution(t.spans), """
    WITH m AS (SELECT *, nanos // 1000000 AS ms FROM spans), s AS (SELECT tr, coalesce(sum(ms) FILTER (name = 'claude_code.llm_request'), 0) AS l,
      coalesce(sum(ms) FILTER (name = 'claude_code.tool.execution'), 0) AS x, (epoch_us(max(et)) - epoch_us(min(st))) // 1000 AS w FROM m GROUP BY tr)
    SELECT tr AS trace_id, CAST(l AS BIGINT) AS llm_ms, CAST(x AS BIGINT) AS tool_ms, CAST(0 AS BIGINT) AS blocked_ms, CAST(w AS BIGINT) AS trace_ms,
      round(l * 100.0 / w, 6) AS llm_percent, round(x * 100.0 / w, 6) AS tool_percent, CAST(0 AS DOUBLE) AS blocked_percent FROM s""")
query("work_tools", lambda t: S.work_tools(t.spans), "SELECT tr AS trace_id, coalesce(tn, 'unknown') AS tool, count(*) AS calls FROM spans WHERE name = 'claude_code.tool' GROUP BY 1, 2")
query("work_models", lambda t: S.work_models(t.spans), "SELECT tr AS trace_id, model, count(*) AS calls FROM spans WHERE name = 'claude_code.llm_request' GROUP BY 1, 2")
query("work_files", lambda t: S.work_files(t.spans), """
    SELECT tr AS trace_id, file_path, tn AS tool, count(*) AS calls, epoch_us(min(st)) AS first_at FROM spans WHERE name = 'claude_code.tool' AND file_path IS NOT NULL GROUP BY 1, 2, 3""")
_DE = """de AS (SELECT u.aid AS id, count(*) AS n FROM tree t JOIN spans s ON s.id = t.id AND s.status = 'error', unnest(t.path[1:len(t.path) - 1]) u(aid) GROUP BY 1)"""
query("descendant_errors", lambda t: S.descendant_errors(t.spans), f"""
    WITH RECURSIVE {_TREE}, {_DE} SELECT s.tr AS trace_id, s.sp AS span_id, coalesce(de.n, 0) AS descendant_errors FROM spans s LEFT JOIN de USING (id)""")
query("waterfall", lambda t: S.waterfall(t.spans, max_rows=2), f"""
    WITH RECURSIVE {_TREE}, {_DE}, o AS (SELECT t.*, row_number() OVER (PARTITION BY t.tr ORDER BY path) AS pre FROM tree t),
    p AS (SELECT o.*, epoch_us(s.st) / 1000.0 AS a, s.nanos / 1e6 AS ms FROM o JOIN spans s USING (id) WHERE depth <= 1 QUALIFY row_number() OVER (PARTITION BY o.tr ORDER BY path) <= 2),
    f AS (SELECT tr, min(a) AS t0, greatest(max(a + ms) - min(a), 1) AS w FROM p GROUP BY tr),
    b AS (SELECT p.*, greatest((a - t0) / w * 100, 0) AS l, least((a - t0 + ms) / w * 100, 100) AS r FROM p JOIN f USING (tr))
    SELECT tr AS trace_id, sp AS span_id, depth, pre AS preorder, coalesce(de.n, 0) AS descendant_errors, round(l, 6) AS left_percent, round(r, 6) AS right_percent,
      round(greatest(r - l, 0), 6) AS width_percent FROM b LEFT JOIN de USING (id)""")
query("same_file_relations", lambda t: S.same_file_relations(t.spans), """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY tr ORDER BY st, sp) AS tno FROM spans WHERE name = 'claude_code.tool' AND tn IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY tr, file_path ORDER BY st, sp) AS fno FROM n WHERE file_path IS NOT NULL)
    SELECT a.tr AS trace_id, a.sp AS span_id, a.file_path, CASE WHEN b.fno < a.fno THEN 'earlier' ELSE 'later' END AS direction, CAST(abs(b.fno - a.fno) AS BIGINT) AS rank,
      b.sp AS related_span_id, CAST(abs(b.tno - a.tno) AS BIGINT) AS calls_away FROM f a JOIN f b ON b.tr = a.tr AND b.file_path = a.file_path AND abs(b.fno - a.fno) BETWEEN 1 AND 3""")
query("span_token_breakdown", lambda t: S.span_token_breakdown(t.spans), """
    SELECT tr AS trace_id, sp AS span_id, ti AS input_tokens, tou AS output_tokens, tcc AS cache_creation_tokens, tcr AS cache_read_tokens, ti + tou + tcc + tcr AS total_tokens
    FROM spans WHERE ti + tou + tcc + tcr > 0""")
query("label_subtree_by_dispatch", lambda t: S.label_subtree_by_dispatch(t.spans), f"""
    WITH RECURSIVE {_TREE}, u AS (SELECT t.tr, t.sp, t.id, a.aid FROM tree t, unnest(t.path) a(aid))
    SELECT u.tr AS trace_id, u.sp AS span_id, 'Subagent' AS label, 'e' || max(u.aid) AS dispatch_span_id FROM u JOIN spans d ON d.id = u.aid AND d.tn = 'Agent' GROUP BY 1, 2""")

_REV = """rv AS (SELECT tr, branch, tn, file_path, coalesce(sum(CASE WHEN tn = 'Edit' THEN 1 ELSE 0 END) OVER (PARTITION BY tr, file_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, n
      FROM ac WHERE name = 'claude_code.tool' AND file_path IS NOT NULL),
    revisits AS (SELECT tr, branch, tn, file_path, g, count(*) AS v, min(n) AS a, max(n) AS b FROM rv GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2)"""
_RES = "res AS (SELECT tr, tuid, success <> 'true' AS failed, error FROM logs WHERE en = 'tool_result' AND tuid IS NOT NULL)"
query("revisited_files", lambda t: X.revisited_files(t.spans), f"""{_TC}, {_REV}
    SELECT tr AS trace_id, branch, tn AS tool, file_path, CAST(g AS BIGINT) AS generation, v AS visits, a AS first_call, b AS last_call FROM revisits""")
# Test commands start with "cd", for which there is no replacement; the text before each is dropped and "grep" read as "cat".
query("shell_antipatterns", lambda t: X.shell_antipatterns(t.spans.withColumn("full_command", F.regexp_replace("full_command", "^cd /w && grep", "  cat"))), f"""{_TC}
    SELECT tr AS trace_id, 'cat' AS command, 'Read' AS replacement, count(*) AS calls, min(n) AS first_call FROM calls WHERE name = 'claude_code.tool' AND command IS NOT NULL GROUP BY tr""")
query("failed_tool_calls", lambda t: X.failed_tool_calls(t.spans, t.logs), f"""{_TC}, {_RES}
    SELECT c.tr AS trace_id, c.sp AS span_id, n AS call_no, tn AS tool, error AS message FROM calls c JOIN res USING (tr, tuid) WHERE c.name = 'claude_code.tool' AND failed""")
# Model calls never fail in the test data; tool spans stand in for them.
_TOOLS_AS_MODELS = replace(CFG, llm_span=CFG.tool_span)
query("failed_model_calls", lambda t: X.failed_model_calls(t.spans, _TOOLS_AS_MODELS), """
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY tr ORDER BY st, sp) AS n FROM spans WHERE name = 'claude_code.tool')
    SELECT tr AS trace_id, CAST(NULL AS BIGINT) AS http_status, 'unknown' AS message, count(*) AS calls, min(n) AS first_call, FALSE AS environmental FROM c WHERE status = 'error' GROUP BY tr""")
# Execution spans stand in for waits, which the test data has none of.
query("blocked_on_user", lambda t: X.blocked_on_user(t.spans, replace(CFG, blocked_span=CFG.tool_execution_span)), f"""{_TC},
    w AS (SELECT tr, parent AS sp, sum(nanos // 1000000) AS ms FROM spans WHERE name = 'claude_code.tool.execution' GROUP BY 1, 2),
    p AS (SELECT c.tr, sum(ms) AS total, count(*) FILTER (ms >= 10000) AS k, max(ms) AS top, first(n ORDER BY ms DESC, n) AS tn FROM calls c JOIN w USING (tr, sp) WHERE c.name = 'claude_code.tool' GROUP BY 1),
    l AS (SELECT tr, (epoch_us(max(et)) - epoch_us(min(st))) // 1000 AS len FROM spans GROUP BY tr)
    SELECT tr AS trace_id, CAST(total AS BIGINT) AS total_blocked_ms, round(total / len, 6) AS blocked_share, k AS long_waits, CAST(top AS BIGINT) AS longest_ms, tn AS longest_call
    FROM p JOIN l USING (tr) WHERE k > 0 AND (total / len >= 0.25 OR top >= 30000) AND top / total < 0.8""")
query("model_call_outlier", lambda t: X.model_call_outlier(t.spans), f"""{_TC}, m AS (SELECT *, nanos // 1000000 AS ms FROM calls WHERE name = 'claude_code.llm_request'),
    p AS (SELECT tr, count(*) AS c, arg_max(struct_pack(n := n, model := model, ms := ms, o := tou), (ms, -n)) AS s, quantile_disc(ms, 0.5) AS med FROM m GROUP BY tr),
    r AS (SELECT tr, quantile_disc(ms / tou, 0.5) AS rate FROM m WHERE tou > 0 GROUP BY tr)
    SELECT tr AS trace_id, s.n AS call_no, s.model AS model, s.ms AS duration_ms, s.o AS output_tokens, med AS median_ms, c AS model_calls FROM p LEFT JOIN r USING (tr)
    WHERE c >= 3 AND s.ms >= 15000 AND med > 0 AND s.ms >= med * 2.5 AND NOT coalesce(s.o > 0 AND rate > 0 AND s.ms / s.o < rate * 2, FALSE)""")
# All test calls read ten parts of fourteen from the cache, just above the limit; output counts as cache creation here.
query("poor_cache_reuse", lambda t: X.poor_cache_reuse(t.spans.withColumn(
    "attributes", F.transform_values("attributes", lambda k, v: F.when(k == "cache_creation_tokens", (v.try_cast("long") * 2).cast("string")).otherwise(v)))), """
    SELECT tr AS trace_id, count(*) AS model_calls, CAST(sum(tcr) AS BIGINT) AS cache_read_tokens, CAST(sum(ti + 2 * tcc + tcr) AS BIGINT) AS prompt_tokens,
      round(sum(tcr) / sum(ti + 2 * tcc + tcr), 6) AS cache_share FROM spans WHERE name = 'claude_code.llm_request' GROUP BY tr
    HAVING count(*) >= 3 AND sum(tcr) > 0 AND sum(tcr) / sum(ti + 2 * tcc + tcr) < 0.7""")
query("context_growth", lambda t: X.context_growth(t.spans, t.logs, start_tokens=900, peak_tokens=600), f"""{_TC},
    p AS (SELECT tr, first(ti + tcc + tcr ORDER BY n) AS s, max(ti + tcc + tcr) AS p, count(*) AS c FROM pc WHERE is_model AND unit = 'main' GROUP BY tr)
    SELECT tr AS trace_id, s AS start_tokens, p AS peak_tokens, c AS main_loop_calls, s >= 900 AS started_loaded, p >= 600 AND p >= s * 2 AS grew_steeply FROM p WHERE s >= 900 OR (p >= 600 AND p >= s * 2)""")
query("cost_concentration", lambda t: X.cost_concentration(t.spans, t.logs), f"""{_TC}, m AS (SELECT * FROM pc WHERE is_model),
    w AS (SELECT tr, sum(usd) AS t, count(*) AS c, max(usd) AS mx, first(n ORDER BY usd DESC, n) AS n FROM m GROUP BY tr HAVING sum(usd) > 0),
    s AS (SELECT tr, dno, sum(usd) AS u FROM m WHERE dno IS NOT NULL GROUP BY 1, 2)
    SELECT tr AS trace_id, 'subagent' AS kind, dno AS call_no, round(u, 6) AS cost_usd, round(u / t, 6) AS share FROM s JOIN w USING (tr) WHERE u / t >= 0.4
    UNION ALL SELECT tr, 'call', n, round(mx, 6), round(mx / t, 6) FROM w WHERE c >= 4 AND mx / t >= 0.25""")
query("adjacent_repeats", lambda t: X.adjacent_repeats(t.spans), f"""{_TC},
    e AS (SELECT tr, n, branch || ' ' || CASE WHEN name = 'claude_code.llm_request' THEN 'llm_request ' || model ELSE concat_ws(' ', tn, coalesce(file_path, command)) END AS content FROM ac),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY tr, content ORDER BY n) AS g FROM e), r AS (SELECT tr, content, g, min(n) AS a, count(*) AS c FROM g GROUP BY 1, 2, 3),
    z AS (SELECT *, min(a) OVER (PARTITION BY tr, content) AS f FROM r)
    SELECT tr AS trace_id, content, a AS first_call, c AS repeat_count, CASE WHEN f < a THEN f END AS repeat_of FROM z""")
query("focused_resolution", lambda t: X.focused_resolution(t.spans, t.logs), f"""{_TC}, {_REV}, {_RES},
    bad AS (SELECT c.tr FROM ac c JOIN res USING (tr, tuid) WHERE c.name = 'claude_code.tool' AND failed UNION SELECT tr FROM ac WHERE name = 'claude_code.llm_request' AND status = 'error'),
    s AS (SELECT *, max(CASE WHEN tn = 'Read' THEN n END) OVER (PARTITION BY tr, branch, file_path ORDER BY n) AS sn FROM ac WHERE name = 'claude_code.tool' AND file_path IS NOT NULL)
    SELECT tr AS trace_id, count(*) AS edits FROM s WHERE tn = 'Edit' AND tr NOT IN (SELECT tr FROM bad) AND tr NOT IN (SELECT tr FROM revisits) GROUP BY tr HAVING bool_and(coalesce(n - sn <= 15, FALSE))""")
query("read_only_resolution", lambda t: X.read_only_resolution(t.spans, t.logs), f"""{_TC}, {_REV}, {_RES},
    p AS (SELECT tr, bool_or(tn = 'Edit') AS e, first(file_path ORDER BY n) AS f, first(tuid ORDER BY n) AS u, min(n) AS n FROM ac WHERE name = 'claude_code.tool' GROUP BY tr),
    q AS (SELECT tr, file_path, tuid, n, row_number() OVER (PARTITION BY tr ORDER BY n) AS o FROM ac WHERE name = 'claude_code.tool')
    SELECT q.tr AS trace_id, q.file_path, q.n AS first_call FROM q JOIN p USING (tr) WHERE o = 1 AND NOT p.e AND q.file_path IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM res WHERE res.tr = q.tr AND res.tuid = q.tuid AND failed) AND q.tr NOT IN (SELECT tr FROM revisits)""")
# Decisions and requests stand in for compactions and skill activations.
query("compaction_runs", lambda t: X.compaction_runs(t.logs, replace(CFG, compaction="tool_decision")), """
    SELECT tr AS trace_id, id, epoch_us(ts) AS timestamp, CAST(NULL AS VARCHAR) AS trigger, FALSE AS failed, CAST(NULL AS BIGINT) AS pre_tokens, CAST(NULL AS BIGINT) AS post_tokens,
      CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS VARCHAR) AS error FROM logs WHERE en = 'tool_decision'""")
query("skill_activations", lambda t: X.skill_activations(t.logs, replace(CFG, skill_activated="api_request")), """
    SELECT tr AS trace_id, skill AS skill_name, epoch_us(min(ts)) AS activated_at, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS trigger, FALSE AS editable
    FROM logs WHERE skill IS NOT NULL GROUP BY 1, 2""")
query("error_lines", lambda t: X.error_lines(t.spans, t.logs), """
    SELECT tr AS trace_id, tn AS source, error AS message, count(*) AS occurrences FROM logs WHERE en = 'tool_result' AND error IS NOT NULL GROUP BY 1, 2, 3""")
query("directed_start", lambda t: X.directed_start(t.spans, t.logs.withColumn("prompt", F.lit("run cd /W && Grep X1 now"))), f"""{_TC},
    p AS (SELECT DISTINCT tr FROM logs WHERE en = 'user_prompt'), q AS (SELECT *, row_number() OVER (PARTITION BY tr ORDER BY n) AS o FROM calls WHERE name = 'claude_code.tool')
    SELECT tr AS trace_id, 'Bash' AS tool, 'w && grep x1' AS file_name, n AS call_no FROM q JOIN p USING (tr) WHERE o = 1 AND command = 'cd /w && grep x1'""")


def _with_bodies(t):
    """The test data has no request bodies; prompts become bodies of model m0 requests of one prompt."""
    key = F.lit("p")
    logs = t.logs.where("event_name IN ('user_prompt', 'api_request')").withColumn("prompt_id", key).withColumn("model", F.lit("m0"))
    return logs.withColumn("event_name", F.when(F.col("event_name") == "user_prompt", "api_request_body").otherwise(F.col("event_name")))


_PAIRING = """
    WITH RECURSIVE line AS (SELECT *, row_number() OVER (PARTITION BY mark, side ORDER BY id) AS turn FROM (
      SELECT CASE WHEN en = 'user_prompt' THEN epoch_us(ts) ELSE epoch_us(ts) - CAST(floor(ms) AS BIGINT) * 1000 END AS mark,
        CASE WHEN en = 'user_prompt' THEN 0 ELSE 1 END AS side, id, rid FROM logs WHERE en IN ('user_prompt', 'api_request') AND (en = 'user_prompt' OR rid IS NOT NULL))),
    cuts AS (SELECT *, CASE WHEN (mark - lag(mark) OVER (ORDER BY mark, turn, side, id)) // 1000 > 60000 THEN 1 ELSE 0 END AS cut FROM line),
    stretches AS (SELECT *, sum(cut) OVER (ORDER BY mark, turn, side, id) AS stretch FROM cuts),
    lists AS (SELECT stretch, list({'mark': mark, 'side': side, 'id': id, 'rid': rid} ORDER BY mark, turn, side, id) AS l FROM stretches GROUP BY stretch),
    steps AS (
      SELECT stretch, l, NULL::STRUCT(gap BIGINT, i BIGINT) AS best, l AS had FROM lists
      UNION ALL
      SELECT stretch, list_concat(l[1:best.i - 1], l[best.i + 2:]), best, l FROM (
        SELECT stretch, l, list_min(list_filter(list_transform(range(1, len(l)), lambda i: CASE WHEN l[i].side <> l[i + 1].side AND (l[i + 1].mark - l[i].mark) // 1000 <= 60000
          THEN {'gap': l[i + 1].mark - l[i].mark, 'i': i} END), lambda c: c IS NOT NULL)) AS best FROM steps WHERE len(l) > 1) WHERE best IS NOT NULL),
    taken AS (SELECT had[best.i] AS x, had[best.i + 1] AS y, best.gap AS gap FROM steps WHERE best IS NOT NULL)
    SELECT 'p' AS prompt_id, 'm0' AS model, CASE WHEN x.side = 0 THEN x.id ELSE y.id END AS body_id, CASE WHEN x.side = 0 THEN y.id ELSE x.id END AS request_log_id,
      CASE WHEN x.side = 0 THEN y.rid ELSE x.rid END AS request_id, gap // 1000 AS offset_ms FROM taken"""
query("pair_bodies_to_requests", lambda t: K.pair_bodies_to_requests(_with_bodies(t), tolerance_ms=60_000), _PAIRING)
query("pair_bodies_in_rounds", lambda t: K.pair_bodies_to_requests(_with_bodies(t), tolerance_ms=60_000, stretch=2), _PAIRING)
query("resolve_leaf_span", lambda t: K.resolve_leaf_span(t.logs.withColumn("span_id", F.concat(F.lit("e"), (F.col("id") - F.col("id") % 20).cast("string"))), t.spans, _execution()), """
    WITH l AS (SELECT *, 'e' || (id - id % 20) AS own FROM logs), x AS (SELECT tr, tuid, min(sp) AS sp FROM spans WHERE name = 'claude_code.tool' AND tuid IS NOT NULL GROUP BY 1, 2),
    q AS (SELECT tr, rid, min(sp) AS sp FROM spans WHERE name = 'claude_code.llm_request' AND rid IS NOT NULL GROUP BY 1, 2)
    SELECT l.id, l.tr AS trace_id, own AS logged_span_id, coalesce(x.sp, q.sp, own) AS span_id FROM l LEFT JOIN x ON x.tr = l.tr AND x.tuid = l.tuid LEFT JOIN q ON q.tr = l.tr AND q.rid = l.rid""")
query("bucket_logs_by_span", lambda t: K.bucket_logs_by_span(t.logs.withColumn("tool_use_id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("c"), F.col("id") - F.col("id") % 20 + 2))), t.spans), f"""
    WITH RECURSIVE {_TREE}, l AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'c' || (id - id % 20 + 2) END AS u FROM logs),
    w AS (SELECT s.tr, s.tuid, s.id FROM spans s WHERE name = 'claude_code.tool' AND tuid IS NOT NULL)
    SELECT l.id, l.tr AS trace_id, CASE WHEN w.id IS NOT NULL AND list_contains(t.path, w.id) THEN l.sp WHEN w.id IS NOT NULL THEN 'e' || w.id ELSE l.sp END AS shown_under,
      CAST(NULL AS DOUBLE) AS event_sequence, epoch_us(l.ts) AS event_time FROM l JOIN tree t ON t.id = l.id LEFT JOIN w ON w.tr = l.tr AND w.tuid = l.u""")
