import itertools
import random
from dataclasses import replace

import pytest
from conftest import HOUR, at, listed

from spanloom.config import CFG
from spanloom.functions.skew import cut_lineage
from spanloom.operators import correlation, span_tree, trace_findings, traces
from spanloom.operators.log_explorer import LogFilter, log_page_offset


def req(t, rid, usd, **a):
    return {"ev": "api_request", "t": t, "trace_id": "t", "a": {"request_id": rid, "cost_usd": usd, **a}}


def test_broken_parents_and_cycles(spans):
    rows = spans({"s": "b", "p": "a", "t": 3}, {"s": "a", "t": 1}, {"s": "orphan", "p": "gone", "t": 0}, {"s": "c", "p": "a", "t": 2},
                 {"s": "x", "p": "y"}, {"s": "y", "p": "x"}, {"s": "z", "p": "y"}, {"s": "d", "p": "b", "t": 4}, {"s": "a", "tr": "u", "t": 9})
    got = listed(span_tree.span_tree(rows), "trace_id", "span_id", "depth", "preorder")
    assert got == [("t", "a", 0, 2), ("t", "b", 1, 4), ("t", "c", 1, 3), ("t", "d", 2, 5), ("t", "orphan", 0, 1), ("u", "a", 0, 1)]


def test_deep_chain(spans):
    rows = spans(*[{"s": f"n{i}", "p": f"n{i - 1}" if i else None, "t": i} for i in range(70)])
    assert listed(span_tree.span_tree(rows).where("depth <> preorder - 1"), "span_id") == []
    assert span_tree.span_tree(rows).count() == 70


def test_preorder_with_far_apart_children(spans):
    rows = spans({"s": "r", "t": 0}, {"s": "k1", "p": "r", "t": 5000}, {"s": "k0", "p": "r", "t": 1}, {"s": "g", "p": "k0", "t": 9000})
    assert listed(span_tree.span_tree(rows), "span_id", "preorder") == [("g", 3), ("k0", 2), ("k1", 4), ("r", 1)]


LLM = "claude_code.llm_request"


def test_cost_breakdown_by_dispatch(spans, logs):
    rows = spans({"s": "root", "n": "claude_code.interaction"}, {"s": "m1", "p": "root", "n": LLM, "a": {"request_id": "r1"}},
                 {"s": "ag", "p": "root", "a": {"tool_name": "Agent"}}, {"s": "ex", "p": "ag", "n": "claude_code.tool.execution"},
                 {"s": "m2", "p": "ex", "n": LLM, "a": {"request_id": "r2"}}, {"s": "inner", "p": "ex", "a": {"tool_name": "Agent"}},
                 {"s": "m3", "p": "inner", "n": LLM, "a": {"request_id": "r3"}}, {"s": "m4", "p": "root", "n": LLM, "a": {"request_id": "r4"}})
    log = logs(req(1, "r1", "1", query_source="sdk"), req(2, "r2", "2", query_source="agent:builtin:Explore"), req(3, "r3", "4"),
               req(4, "r4", "8", query_source="compact"), {**req(5, "r1", "1.5", query_source="sdk")})
    got = listed(span_tree.trace_cost_breakdown(rows, log), "unit", "dispatch_no", "label", "cost_usd", "model_calls", "tool_calls")
    assert got == [("auxiliary", None, None, 8.0, 1, 0), ("main", None, None, 1.5, 1, 0),
                   ("subagent", 2, "Explore", 2.0, 1, 1), ("subagent", 4, "subagent", 4.0, 1, 0)]
    total = span_tree.trace_cost_totals(rows, log).first()
    assert (total.measured_usd, total.costliest_call) == (15.5, 6)


def test_summary_window_does_not_bound_the_root(spans, logs):
    rows = spans({"s": "r", "t": -100, "n": "model.x", "a": {"session.id": "q"}}, {"s": "k", "p": "r", "t": 10, "st": "error"})
    r = traces.trace_summaries(rows, logs({"ev": "x"}), HOUR).first()
    assert (r.root_span_id, r.span_count, r.error_count, r.status, r.service, r.session_id) == ("r", 1, 1, "error", "claude_code.models", "q")


@pytest.fixture(scope="module")
def many(spans, logs):
    rnd = random.Random(5)
    rows = [{"tr": f"t{i:02}", "s": f"s{i}-{j}", "t": i // 2 * 60 + j, "d": rnd.randrange(1, 4), "st": rnd.choice(["ok", "error"]),
             "a": {"input_tokens": str(rnd.randrange(3))}} for i in range(16) for j in range(rnd.randrange(1, 4))]
    costs = [{"ev": "api_request", "t": i, "trace_id": f"t{i:02}", "a": {"cost_usd": str(rnd.randrange(3))}} for i in range(0, 16, 2)]
    return spans(*rows).cache(), logs(*costs).cache()


@pytest.mark.parametrize("sort", list(traces.SORTS))
def test_pages_tile_the_list(many, sort):
    """Walking by cursor and by offset gives the whole list once, in the same order."""
    rows, log = many
    ids = lambda df: [r.trace_id for r in df.collect()]
    whole = ids(traces.trace_list(rows, log, sort, "offset", size=100))
    assert sorted(whole) == [f"t{i:02}" for i in range(16)]
    assert ids(traces.trace_list(rows, log, sort, size=4)) == whole[:5]
    assert ids(traces.trace_list(rows, log, sort, "offset", page=2, size=5)) == whole[10:15]
    key = traces.trace_cursor_key(rows, log, sort, whole[5])
    assert ids(traces.trace_list(rows, log, sort, "before", cursor=key, size=3)) == whole[6:10]
    after = ids(traces.trace_list(rows, log, sort, "after", cursor=key, size=2))
    assert after == (whole[2:5] if sort == "old" else whole[:3])
    assert traces.trace_cursor_key(rows, log, sort, "gone") is None
    assert ids(traces.trace_list(rows, log, sort, "before", cursor=None, size=3)) == whole[:4]


def test_in_progress_needs_no_root_and_recent_activity(spans, logs):
    rows = spans({"tr": "a", "p": "x", "t": 10}, {"tr": "b", "t": 10}, {"tr": "c", "p": "x", "t": 0})
    log = logs({"ev": "x", "t": 50, "trace_id": "c"}, {"ev": "x", "t": 90, "trace_id": "d"})
    assert listed(traces.in_progress_traces(rows, log, at(20)), "trace_id") == [("c",)]


def tool(t, name, path=None, **more):
    return {"t": t, "a": {"tool_name": name, **({"file_path": path} if path else {}), **more}}


def test_an_edit_starts_a_new_generation(spans):
    rows = spans(tool(0, "Read", "/a"), tool(1, "Edit", "/a"), tool(2, "Read", "/a"), tool(3, "Read", "/b"), tool(4, "Read", "/a"))
    got = listed(trace_findings.revisited_files(rows), "tool", "file_path", "generation", "visits", "first_call", "last_call")
    assert got == [("Read", "/a", 1, 2, 3, 5)]


def test_focused_and_read_only(spans, logs):
    none = logs({"ev": "x"})
    focused = spans(tool(0, "Read", "/a"), tool(1, "Edit", "/a"))
    assert listed(trace_findings.focused_resolution(focused, none), "edits") == [(1,)]
    blind = spans(tool(0, "Read", "/b"), tool(1, "Edit", "/a"))
    assert trace_findings.focused_resolution(blind, none).count() == 0
    failed = logs({"ev": "tool_result", "trace_id": "t", "a": {"tool_use_id": "c", "success": "false"}})
    assert trace_findings.focused_resolution(spans(tool(0, "Read", "/a", tool_use_id="c"), tool(1, "Edit", "/a")), failed).count() == 0
    assert listed(trace_findings.read_only_resolution(spans(tool(0, "Read", "/a")), none), "file_path") == [("/a",)]
    assert trace_findings.read_only_resolution(focused, none).count() == 0


def test_one_long_pause_is_not_a_finding(spans):
    wait = CFG.blocked_span
    alone = spans({"s": "a", "a": {"tool_name": "X"}}, {"s": "w", "p": "a", "n": wait, "d": 100})
    assert trace_findings.blocked_on_user(alone).count() == 0
    two = spans({"s": "a"}, {"s": "b"}, {"s": "w", "p": "a", "n": wait, "d": 60}, {"s": "v", "p": "b", "n": wait, "d": 40})
    assert listed(trace_findings.blocked_on_user(two), "total_blocked_ms", "long_waits", "longest_call") == [(100_000, 2, 1)]


def test_environmental_failures(spans):
    rows = spans({"n": LLM, "a": {"error": "busy", "status_code": "429"}}, {"n": LLM, "a": {"error": "bad", "status_code": "400"}}, {"n": LLM, "st": "error"})
    assert listed(trace_findings.failed_model_calls(rows), "message", "http_status", "environmental") == [
        ("bad", 400, False), ("busy", 429, True), ("unknown", None, False)]


def test_related_calls_reach_three_each_way(spans):
    rows = spans(*[tool(i, "Read", "/a" if i % 2 == 0 else "/b") for i in range(10)])
    mine = span_tree.same_file_relations(rows).where("span_id = 's8'")
    assert listed(mine, "direction", "rank", "related_span_id", "calls_away") == [("earlier", 1, "s6", 2), ("earlier", 2, "s4", 4), ("earlier", 3, "s2", 6)]


def brute_pairs(bodies, requests, tolerance):
    edges = sorted((abs(b - r) // 1000, i, j) for (i, b), (j, r) in itertools.product(bodies.items(), requests.items()) if abs(b - r) // 1000 <= tolerance)
    used_b, used_r, out = set(), set(), set()
    for _, i, j in edges:
        if i not in used_b and j not in used_r:
            used_b.add(i)
            used_r.add(j)
            out.add((i, j))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_body_pairing_equals_greedy(logs, seed):
    """Distances are all different here, so the greedy choice is unique."""
    rnd = random.Random(seed)
    times = rnd.sample(range(0, 12_000), 40)
    common = {"prompt.id": "p", "model": "m"}
    rows, bodies, requests = [], {}, {}
    for i, ms in enumerate(times):
        if i % 2:
            rows.append({"ev": "api_request_body", "t": ms / 1000, "a": common})
            bodies[i] = ms * 1000
        else:
            rows.append({"ev": "api_request", "t": ms / 1000, "a": {**common, "request_id": f"r{i}", "duration_ms": "500"}})
            requests[i] = (ms - 500) * 1000
    got = {(r.body_id, r.request_log_id) for r in correlation.pair_bodies_to_requests(logs(*rows)).collect()}
    want = brute_pairs(bodies, requests, 1000)
    gaps = sorted(abs(bodies[i] - requests[j]) for i, j in itertools.product(bodies, requests))
    if len(set(gaps)) == len(gaps):
        assert got == want
    total = lambda pairs: sorted(abs(bodies[i] - requests[j]) // 1000 for i, j in pairs)[:5]
    assert len(got) == len(want) and total(got) == total(want)


def test_closest_pairs_match_all_pairs_sorted():
    rnd = random.Random(11)
    for _ in range(300):
        marks = sorted(rnd.sample(range(10**7), rnd.randrange(2, 30)))
        side = [rnd.randrange(2) for _ in marks]
        want = brute_pairs({i: t for i, t in enumerate(marks) if side[i] == 0}, {i: t for i, t in enumerate(marks) if side[i] == 1}, 2000)
        got = {(i, j) if side[i] == 0 else (j, i) for i, j in correlation.closest_pairs(marks, side, 2000)}
        gaps = [abs(a - b) // 1000 for a, b in itertools.combinations(marks, 2)]
        assert len(set(gaps)) < len(gaps) or got == want
    assert correlation.closest_pairs([0, 10, 11, 20], [0, 1, 1, 0], 1) == [(2, 3), (0, 1)]
    assert correlation.closest_pairs([], [], 5) == []


def test_pairs_of_a_part_of_a_line_are_pairs_of_the_whole():
    rnd = random.Random(5)
    taken = 0
    for _ in range(500):
        line = sorted((rnd.randrange(200) * 1000, rnd.randrange(2)) for _ in range(rnd.randrange(2, 60)))
        at, side = [r[0] for r in line], [r[1] for r in line]
        low = rnd.randrange(len(line) - 1)
        high = rnd.randrange(low + 1, len(line) + 1)
        part = {(i + low, j + low) for i, j in correlation.closest_pairs(at[low:high], side[low:high], 20, low > 0, high < len(line))}
        assert part <= set(correlation.closest_pairs(at, side, 20))
        taken += len(part)
    assert taken > 500


def test_a_long_stretch_takes_few_rounds(spark, logs, monkeypatch):
    """Bodies, then as many requests, are taken from the inside out: one pair a round if only nearest pairs are."""
    common = {"prompt.id": "p", "model": "m"}
    rows = [{"ev": "api_request_body", "t": i * 0.01, "a": common} for i in range(20)]
    rows += [{"ev": "api_request", "t": 0.3 + i * 0.0101, "a": {**common, "request_id": f"r{i}", "duration_ms": "0"}} for i in range(20)]
    rows += [{**r, "t": r["t"] + 0.9} for r in rows]
    monkeypatch.setattr(correlation, "BLOCK", 24)
    cuts = []
    monkeypatch.setattr(correlation, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    made = logs(*rows).cache()
    whole = correlation.pair_bodies_to_requests(made)
    cuts.clear()
    got = correlation.pair_bodies_to_requests(made, stretch=2)
    assert listed(got, *got.columns) == listed(whole, *got.columns)
    assert len(cuts) < 15


def _calls(times):
    common = {"prompt.id": "p", "model": "m"}
    return [{"ev": "api_request_body", "t": t, "a": common} if body else {"ev": "api_request", "t": t, "a": {**common, "request_id": f"r{i}", "duration_ms": "0"}}
            for i, (t, body) in enumerate(times)]


def _paired(df):
    return sorted((r.body_id, r.request_log_id, r.request_id, r.offset_ms) for r in df.collect())


def test_pairing_in_rounds_equals_at_once(logs):
    rnd = random.Random(5)
    for spread in (40, 2):
        rows = logs(*_calls([(rnd.randrange(spread * 1000) / 1000, rnd.random() < 0.5) for _ in range(120)]))
        whole = _paired(correlation.pair_bodies_to_requests(rows))
        assert whole and _paired(correlation.pair_bodies_to_requests(rows, stretch=8)) == whole


def test_even_spacing_and_simultaneous_calls(logs):
    even = _paired(correlation.pair_bodies_to_requests(logs(*_calls([(i / 10, i % 2 == 0) for i in range(10_000)]))))
    assert even == [(i, i + 1, f"r{i + 1}", 100) for i in range(0, 10_000, 2)]
    at_once = _paired(correlation.pair_bodies_to_requests(logs(*_calls([(5, i < 4) for i in range(8)]))))
    assert at_once == [(i, i + 4, f"r{i + 4}", 0) for i in range(4)]
    assert _paired(correlation.pair_bodies_to_requests(logs({"ev": "x"}))) == []


def test_leaf_span_only_moves_down(logs, spans):
    rows = spans({"s": "root", "n": "claude_code.interaction"}, {"s": "tool", "p": "root"},
                 {"s": "exec", "p": "tool", "n": "claude_code.tool.execution", "a": {"tool_use_id": "c"}},
                 {"s": "llm", "p": "root", "n": LLM, "a": {"request_id": "r"}})
    log = logs({"ev": "a", "trace_id": "t", "span_id": "root", "a": {"tool_use_id": "c"}}, {"ev": "b", "trace_id": "t", "span_id": "llm", "a": {"tool_use_id": "c"}},
               {"ev": "c", "trace_id": "t", "a": {"request_id": "r"}}, {"ev": "d", "trace_id": "t", "span_id": "tool"})
    assert listed(correlation.resolve_leaf_span(log, rows), "id", "span_id") == [(0, "exec"), (1, "llm"), (2, "llm"), (3, "tool")]


def test_logs_fall_under_tool_span_or_root(logs, spans):
    rows = spans({"s": "root", "n": "claude_code.interaction"}, {"s": "tool", "p": "root", "a": {"tool_use_id": "c"}}, {"s": "in", "p": "tool", "n": "x"},
                 {"s": "far", "p": "root", "n": "x"})
    log = logs(*[{"ev": "e", "trace_id": "t", "span_id": s, "a": a} for s, a in (
        ("in", {"tool_use_id": "c"}), ("far", {"tool_use_id": "c"}), ("far", {}), ("gone", {}), (None, {"tool_use_id": "zz"}))])
    assert listed(correlation.bucket_logs_by_span(log, rows), "id", "shown_under") == [(0, "in"), (1, "tool"), (2, "far"), (3, "root"), (4, "root")]


def test_skill_activation_keeps_the_first(logs):
    ev = {"ev": "skill_activated", "trace_id": "t"}
    rows = logs({**ev, "a": {"skill.name": "k", "skill.source": "projectSettings"}}, {**ev, "a": {"skill.name": "k", "skill.source": "user"}})
    assert listed(trace_findings.skill_activations(rows), "skill_name", "source", "editable") == [("k", "projectSettings", True)]


def test_config_is_replaceable():
    assert replace(CFG, tool_span="x").tool_span == "x"


def test_spans_delivered_again_count_once(spans):
    chain = [{"s": f"s{i}", "p": f"s{i - 1}" if i else None, "t": i} for i in range(8)]
    assert listed(span_tree.span_tree(spans(*chain, *chain)), "span_id", "depth") == [(f"s{i}", i) for i in range(8)]


def test_prompts_and_pages_are_whole_by_default(logs):
    rows = logs(*[{"ev": "user_prompt", "t": t, "trace_id": "t", "a": {"prompt": "x  y" * 200, "session.id": "s"}} for t in range(600)])
    whole = "x y" * 200
    assert [r.first_user_prompt for r in traces.first_prompt_by_trace(rows).collect()] == [whole]
    assert [r.first_user_prompt for r in traces.first_prompt_by_trace(rows, 5).collect()] == [whole[:5]]
    assert log_page_offset(rows, LogFilter(HOUR), 0, 600).count() == 600
