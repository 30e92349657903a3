import json

from conftest import HOUR, at, listed

from spanloom.config import TimeRange
from spanloom.operators import cost, log_explorer, tools, traces, tuning


def call(tool="Read", t=0, session="s", **a):
    attrs = {"tool_name": tool, "session.id": session, "success": "true"}
    if "path" in a:
        attrs["tool_input"] = json.dumps({"file_path": a.pop("path")})
    if "command" in a:
        attrs["tool_input"] = json.dumps({"command": a.pop("command")})
    if "size" in a:
        attrs["tool_result_size_bytes"] = str(a.pop("size"))
    if "ms" in a:
        attrs["duration_ms"] = str(a.pop("ms"))
    return {"ev": "tool_result", "t": t, "a": {**attrs, **a}}


def request(t=0, session="s", **a):
    return {"ev": "api_request", "t": t, "a": {"session.id": session, **{k.replace("_DOT_", "."): v for k, v in a.items()}}}


def test_window_is_closed(logs):
    rows = logs(call(t=-1), call(t=0), call(t=3600), call(t=3601))
    assert listed(tools.tool_calls(rows, HOUR), "tool", "calls") == [("Read", 2)]


def test_blank_mcp_parameters_are_unknown(logs):
    rows = logs(call("mcp_tool", tool_parameters='{"mcp_server_name": "", "mcp_tool_name": "x"}'), call("mcp_tool", tool_parameters="oops"),
                call("mcp_tool", tool_parameters='{"mcp_server_name": "gh", "mcp_tool_name": "x"}', ms=10, size=8))
    usage = tools.mcp_usage(rows, HOUR)
    assert listed(usage, "server", "mcp_tool", "calls") == [("gh", "x", 1), ("unknown", "unknown", 1), ("unknown", "x", 1)]
    rollup = {r.server: r for r in tools.mcp_server_rollup(usage).collect()}
    assert rollup["unknown"].share_percent == 200 / 3 and rollup["gh"].mean_ms == 10


def test_tool_repeats_runs_and_unknown_scope(logs):
    rows = logs(*[call(t=i, path="/a", size=40) for i in range(3)], call("mcp_tool", t=3), call(t=4, path="/a", size=40),
                *[call("mcp_tool", t=5 + i) for i in range(3)], *[call(t=10 + i, path="/a", session="z") for i in range(2)],
                *[call("Bash", t=20 + i, command="cd x && git status -s") for i in range(2)])
    got = listed(tools.tool_repeats(rows, HOUR), "tool", "scope", "max_run", "median_run", "sessions", "estimated_tokens_burned")
    # Median of runs 3 and 2 is 2.5, which rounds to even.
    assert got == [("Bash", "git status", 2, 2, 1, 0), ("Read", "/a", 3, 2, 2, 30)]


def test_skill_counts_once_per_prompt_and_skips_subagents(logs):
    skill = {"skill_DOT_name": "s1", "prompt_DOT_id": "p1"}
    rows = logs(request(60, model="a", cost_usd="1", **skill), request(90, model="b", cost_usd="2", **skill),
                request(100, model="c", cost_usd="4", agent_DOT_name="x", **skill), request(120, model="a", skill_DOT_name="s1"),
                request(130, model="a", skill_DOT_name="s1"))
    assert listed(tools.skill_usage(rows, HOUR), "identifier", "model", "calls") == [("s1", "a", 3)]
    assert listed(tools.skill_cost(rows, HOUR), "model", "cost_usd") == [("a", 1.0), ("b", 2.0), ("c", 4.0)]


def test_subagent_model_is_the_latest_main_turn_before(logs):
    rows = logs(request(-900, model="old"), request(10, model="main"), request(20, model="sub", agent_DOT_name="x"),
                call("Agent", t=20, subagent_type="E"), call("Agent", t=5), call("Agent", t=10, session="other"),
                request(30, model="", session="s"), call("Agent", t=40))
    got = listed(tools.subagent_usage(rows, HOUR), "identifier", "model", "calls")
    assert got == [("E", "main", 1), ("general-purpose", "old", 1), ("general-purpose", "unknown", 2)]


def test_subagent_cost_follows_the_spans(logs, spans):
    rows = logs(call("Agent", t=1, tool_use_id="c1", subagent_type="E"), call("Agent", t=2, tool_use_id="c2"),
                request(3, request_id="r1", model="m", cost_usd="0.5"), request(3, request_id="r2", model="m", cost_usd="9"))
    tree = spans({"s": "x", "n": "claude_code.tool.execution", "a": {"tool_use_id": "c1"}},
                 {"s": "y", "p": "x", "n": "claude_code.llm_request", "a": {"request_id": "r1"}},
                 {"s": "z", "p": "q", "n": "claude_code.llm_request", "a": {"request_id": "r2"}})
    assert listed(tools.subagent_cost(rows, tree, HOUR), "identifier", "model", "cost_usd") == [("E", "m", 0.5)]


def test_categories_partition_the_requests(logs):
    rows = logs(request(1, query_source="agent:x", skill_DOT_name="s", cost_usd="1"), request(2, skill_DOT_name="s", cost_usd="2"),
                request(3, query_source="sdk", cost_usd="4"), request(4, query_source="t", cost_usd="oops"), request(5, cost_usd="8"))
    got = cost.cost_by_category(rows, HOUR, 600).collect()
    total = [r for r in got if r.category_grouped == 1]
    per = {r.category: (r.cost_usd, r.requests) for r in got if r.category_grouped == 0 and r.bucket_grouped == 1}
    assert [(r.cost_usd, r.requests) for r in total] == [(15.0, 5)]
    assert per == {"SUBAGENT": (1.0, 1), "SKILL": (2.0, 1), "MAIN_LOOP": (4.0, 1), "AUXILIARY": (8.0, 2)}


def test_headline_without_prior_has_no_change(logs):
    r = cost.cost_headline(logs(request(0, cost_usd="3"), request(3600, cost_usd="1")), HOUR).first()
    assert (r.current_usd, r.prior_usd, r.delta_percent, r.burn_usd_per_hour, r.projected_30d_usd) == (4.0, 0.0, 0.0, 4.0, 2880.0)


def test_prior_is_half_open(logs):
    rows = logs(request(0, cost_usd="1"), request(-1, cost_usd="2"), request(-3600, cost_usd="4"), request(-3601, cost_usd="8"))
    assert cost.prior_cost(rows, HOUR).first().prior_total == 6.0


def test_reads_patterns(logs):
    rows = logs(*[call(t=60 * i, path="/hunt") for i in range(3)], call(t=0, path="/far"), call(t=2000, path="/far"),
                call(t=0, path="/near"), call(t=600, path="/near"), call(t=5, path="/once"))
    assert listed(tuning.redundant_reads(rows, HOUR), "file_path", "reads", "max_gap_minutes", "pattern") == [
        ("/far", 2, 33.0, "spread across session"), ("/hunt", 3, 1.0, "hunting loop"), ("/near", 2, 10.0, "tight cluster")]


def test_near_misses_stay_in_the_session(logs):
    rows = logs(call(t=1, path="/src/main.py"), call(t=2, path="/src/mian.py", success="false"), call(t=3, path="/src/main.py", success="false"),
                call(t=4, path="/src/mainz.py", session="z"), call(t=5, path="/other", success="false"))
    assert listed(tuning.path_near_misses(rows, HOUR), "failed_path", "nearest_path", "edit_distance") == [("/src/mian.py", "/src/main.py", 2)]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_misses_of_all_paths_equal_brute_force(logs):
    import random

    draw = random.Random(5)
    base = ["/s/ab", "a", "xy", "/src/main/app.py", "/src/test/abba.py"]

    def bent():
        text = list(draw.choice(base))
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(text) + 1)
            text[at:at + draw.randrange(2)] = draw.choice(["", "a", "b", "/"])
        return "".join(text) or "q"

    good, bad = sorted({bent() for _ in range(60)}), sorted({bent() for _ in range(60)})
    rows = logs(*[call(t=i, path=p) for i, p in enumerate(good)], *[call(t=100 + i, path=p, success="false") for i, p in enumerate(bad)])
    wanted = []
    for p in bad:
        near = min(((d, g) for g in good if 0 < (d := _edits(p, g)) <= 3), default=None)
        wanted += [(p, near[1], near[0])] if near else []
    assert len(wanted) > 25
    assert sorted(listed(tuning.path_near_misses(rows, HOUR), "failed_path", "nearest_path", "edit_distance")) == wanted


def test_suggestions_see_more_than_the_listed_rows(logs):
    tight = [call(t=60 * i + k, path=f"/tight{k}") for k in range(12) for i in (0, 20, 40, 50)]
    hunted = [call(t=60 * i, path="/hunt") for i in range(3)]
    found = listed(tuning.suggestions(logs(*tight, *hunted), HOUR), "kind", "subject")
    assert ("hunting", "/hunt") in found


def test_tunable_leaves_out_images_and_agents(logs):
    rows = logs(call(path="/a.PNG", size=9), call("Agent", size=9), call(path="/a.py", size=9))
    assert listed(tools.tunable_context_footprint(rows, HOUR), "tool", "total_bytes") == [("Read", 9)]


def test_share_of_nothing(logs):
    empty = TimeRange(at(-10), at(-5))
    assert tools.with_share(tools.tool_calls(logs(call()), empty)).count() == 0


def test_limits_can_be_lifted(logs, spans):
    rows = logs(*[{"ev": "tool_result", "t": i, "a": {"tool_name": f"T{i:02d}", "session.id": "s"}} for i in range(60)],
                *[{"ev": "api_request", "t": i, "a": {"cost_usd": "1", "session.id": f"s{i}", "model": "m"}} for i in range(20)])
    assert log_explorer.log_facet_tool(rows, log_explorer.LogFilter(HOUR)).count() == 50
    assert log_explorer.log_facet_tool(rows, log_explorer.LogFilter(HOUR), None).count() == 60
    assert cost.top_cost_sessions(rows, HOUR).count() == 10 and cost.top_cost_sessions(rows, HOUR, None).count() == 20
    assert tools.tool_calls_timeseries(rows, HOUR, 3600).count() == 9 and tools.tool_calls_timeseries(rows, HOUR, 3600, None).count() == 60
    some = spans(*[{"s": f"s{i}", "tr": f"t{i}", "n": "claude_code.interaction", "t": i, "a": {"session.id": f"s{i}"}} for i in range(20)])
    kinds = lambda **k: traces.trace_facets(some, traces.TraceFilter(HOUR), **k).where("facet_kind = 'session'").count()
    assert kinds() == 8 and kinds(session_limit=None) == kinds(limit=None, session_limit=None) == 20
