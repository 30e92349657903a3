from conftest import HOUR, at, listed

from spanloom.config import CFG
from spanloom.operators import sessions, turns

COST, ACTIVE, TOKEN, START = CFG.cost_metric, CFG.active_metric, CFG.token_metric, CFG.session_metric


def test_summary_is_whole_life_but_tokens_are_windowed(points):
    s = {"session.id": "s"}
    rows = points({"m": COST, "v": 2, "t": -500, "a": s}, {"m": COST, "v": 5, "t": 10, "a": s}, {"m": ACTIVE, "v": 60, "t": 100, "a": s},
                  {"m": ACTIVE, "v": 60, "t": 3000, "a": s},
                  {"m": TOKEN, "v": 7, "t": -5, "a": {**s, "type": "input"}}, {"m": TOKEN, "v": 9, "t": 5, "a": {**s, "type": "input"}},
                  {"m": START, "v": 1, "t": 20, "a": {**s, "start_type": "fresh"}}, {"m": START, "v": 1, "t": 30, "a": {**s, "start_type": "resume"}},
                  {"m": COST, "v": 9, "t": -100, "a": {"session.id": "old"}})
    r = sessions.session_summaries(rows, HOUR).collect()
    assert [(x.session_id, x.cost_usd, x.active_time_seconds, x.wall_seconds, x.input_tokens, x.start_type, x.total_count) for x in r] == [
        ("s", 5.0, 60.0, 600, 2, "fresh", 1)]


def test_a_session_of_ghost_rows_is_not_listed(points):
    rows = points({"m": COST, "v": 2, "t": -500}, {"m": COST, "v": 2, "t": 10})
    assert sessions.session_summaries(rows, HOUR).count() == 0
    assert sessions.session_kpis(rows, HOUR).first().median_cost_usd == 0.0


def test_ratio_sorts_put_missing_last_both_ways(points):
    rows = points({"v": 1, "a": {"session.id": "a"}}, {"m": ACTIVE, "v": 60, "a": {"session.id": "a"}}, {"v": 9, "a": {"session.id": "b"}})
    for descending in (True, False):
        got = [r.session_id for r in sessions.session_summaries(rows, HOUR, "costPerMinute", descending).collect()]
        assert got == ["a", "b"]


def prompt(t, session="s", trace=None, **a):
    return {"ev": "user_prompt", "t": t, "trace_id": trace, "a": {"session.id": session, **{"prompt": f"p {t}", **a}}}


def test_first_prompt_skips_empty_ones(logs):
    rows = logs(prompt(0, prompt=""), prompt(5, prompt=" a \n b "), prompt(9))
    assert listed(sessions.first_prompts(rows), "first_user_prompt") == [(" a b ",)]
    assert sessions.session_counts(rows).first().user_prompt_count == 3


def test_in_progress_looks_at_the_newest_prompt_only(logs, spans):
    rows = logs(prompt(0, trace="open"), prompt(10, trace="done"), prompt(10, "z", trace="run"), prompt(10, "y", trace="0" * 32))
    done = spans({"tr": "done", "n": "claude_code.interaction", "t": 20}, {"tr": "run", "p": "q", "n": "x", "t": 50})
    assert listed(sessions.in_progress_sessions(rows, done, at(30)), "session_id") == [("z",)]
    assert sessions.in_progress_sessions(rows, done, at(60)).count() == 0


def test_background_work_needs_the_grace_to_pass(logs, spans):
    done = spans({"tr": "t", "n": "claude_code.interaction", "t": 0, "d": 10})
    rows = logs({"ev": "x", "t": 15, "trace_id": "t", "a": {"session.id": "s"}}, {"ev": "x", "t": 16, "trace_id": "t", "a": {"session.id": "z"}})
    assert listed(sessions.background_active(rows, done, at(-60)), "session_id") == [("z",)]


def test_events_before_the_first_turn_are_dropped(logs):
    rows = logs(prompt(10), prompt(20), {"ev": "tool_result", "t": 5, "a": {"session.id": "s", "tool_name": "R"}},
                *[{"ev": "tool_result", "t": t, "a": {"session.id": "s", "tool_name": "R"}} for t in (10, 19, 20, 5000)])
    got = turns.assign_turn(turns.tool_events(rows), turns.turns(rows))
    assert sorted((r.timestamp.second + r.timestamp.minute * 60 + r.timestamp.hour * 3600, r.turn_no) for r in got.collect()) == [
        (10, 1), (19, 1), (20, 2), (5000, 2)]


def test_a_trace_is_billed_to_its_first_turn(logs, points, spans):
    def request(t, trace, usd, prompt_id=None):
        return {"ev": "api_request", "t": t, "trace_id": trace, "a": {"session.id": "s", "cost_usd": usd, "model": "m", "input_tokens": "3",
                                                                      **({"prompt.id": prompt_id} if prompt_id else {})}}
    rows = logs(prompt(0, trace="a"), prompt(10, trace="a"), prompt(20), prompt(30, **{"prompt.id": "p"}),
                request(1, "a", "1"), request(11, "a", "2"), request(40, None, "5", "p"), request(500, "a", "4"))
    closed = spans({"tr": "a", "n": "claude_code.interaction", "t": 0, "d": 100})
    counters = points({"v": 100, "t": 1}, {"v": 300, "t": 11}, {"v": 350, "t": 21})
    got = {r.turn_no: r for r in turns.prompt_timeline(rows, counters, closed).collect()}
    assert [got[n].cost_usd for n in (1, 2, 3, 4)] == [7.0, None, 50.0, 5.0]
    assert [got[n].attribution for n in (1, 2, 3, 4)] == ["INTERVAL", "INTERVAL", "INTERVAL", "REQUEST"]
    assert got[1].background_cost_usd == 4.0 and got[1].input_tokens == 9 and got[4].input_tokens == 3


def test_dispatched_turns_nest(logs):
    note = "<task-notification><tool-use-id>c1</tool-use-id></task-notification>"
    rows = logs(prompt(0, trace="a"), {"ev": "tool_result", "t": 1, "trace_id": "a", "a": {"session.id": "s", "tool_use_id": "c1"}},
                prompt(5, trace="b"), prompt(10, trace="c", prompt=note), prompt(11, trace="a", prompt=note))
    t = turns.turns(rows)
    found = turns.dispatched_turns(t, rows)
    assert listed(found, "turn_no", "dispatching_trace_id") == [(3, "a")]
    nested = turns.nest_turns(t.join(found, ["session_id", "turn_no"], "left"))
    assert listed(nested, "turn_no", "parent_no", "depth") == [(1, None, 0), (2, None, 0), (3, 1, 1), (4, None, 0)]
