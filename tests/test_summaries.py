"""Summaries kept at ingest: equal to what the tables say, and enough to leave other days unread."""

import glob
import random
from datetime import timedelta

import pytest
from conftest import T0, at, listed
from pyspark.sql import functions as F

from spanloom.config import CFG, TimeRange
from spanloom.operators import metrics, sessions, traces, trends
from spanloom.sources.deltas import counter_deltas
from spanloom.sources.summaries import Summaries
from spanloom.sources.tables import read_points, read_summaries, read_telemetry, write_telemetry
from spanloom.streaming.ingest import merge_points

DAY = 86_400
W = TimeRange(T0 + timedelta(days=2), T0 + timedelta(days=3) - timedelta(seconds=1))


@pytest.fixture(scope="module")
def tables(logs, points, spans, spark, tmp_path_factory):
    rnd, root = random.Random(3), str(tmp_path_factory.mktemp("kept"))
    ps, ls, ss, totals = [], [], [], {}
    for i in range(240):
        day, s = rnd.choice([0, 1, 1, 2, 2]), f"s{rnd.randrange(9)}"
        t = day * DAY + rnd.randrange(DAY)
        m = rnd.choice([CFG.cost_metric, CFG.token_metric, CFG.active_metric, CFG.session_metric])
        a = {"session.id": s, **({"type": rnd.choice(CFG.token_types)} if m == CFG.token_metric else {}), **({"start_type": "fresh"} if m == CFG.session_metric else {})}
        ps.append((t, m, a))
    for t, m, a in sorted(ps, key=lambda p: p[0]):
        key = (m, *a.values())
        totals[key] = totals.get(key, 0) + rnd.choice([0, 1, 2.5])
        ps[ps.index((t, m, a))] = {"t": t, "m": m, "v": totals[key], "a": a}
    for i in range(60):
        day, tr = rnd.choice([0, 1, 2]), f"t{rnd.randrange(20)}"
        t = day * DAY + rnd.randrange(DAY)
        ls.append({"ev": "api_request", "t": t, "trace_id": tr, "a": {"session.id": f"s{i % 9}", "cost_usd": "0.25"}})
        ls.append({"ev": "user_prompt", "t": t, "trace_id": tr, "a": {"session.id": f"s{i % 9}", "prompt": "do"}})
        ss.append({"tr": tr, "t": t, "d": 5, "p": rnd.choice([None, "x"]), "n": rnd.choice(["claude_code.interaction", "other"]), "a": {"session.id": f"s{i % 9}"}})
    for table, df in (("points", points(*ps)), ("logs", logs(*ls)), ("spans", spans(*ss))):
        for batch in range(3):
            write_telemetry(df.where(F.pmod("id", F.lit(3)) == batch), root, table, batch)
    return root


def answers(p, lo, sp, kept):
    f, since = traces.TraceFilter(W), T0 + timedelta(days=2)
    return {
        "session_summaries": sessions.session_summaries(p, W, kept=kept), "new_sessions": sessions.new_sessions_trend(p, W, 6, kept=kept),
        "worst_cache": sessions.worst_cache_sessions(p, W, 1, None, kept=kept), "background": sessions.background_active(lo, sp, since, kept=kept),
        "in_progress": sessions.in_progress_sessions(lo, sp, since, kept=kept), "open_traces": traces.in_progress_traces(sp, lo, since, kept=kept),
        "periods": trends.sessions_current_prior(p, W, kept=kept), "sparklines": trends.sparklines_combined(p, W, 7200, kept=kept),
        "session_trend": trends.session_trend(p, W, 7200, kept=kept), "trends": trends.trends(p, lo, W, kept=kept).select("metric", "before", "after"),
        "names": metrics.metric_names(p, kept), "traces": traces.trace_summaries(sp, lo, W, kept=kept), "count": traces.trace_count(sp, f, kept),
        "list": traces.trace_list(sp, lo, "cost", f=f, kept=kept), "histogram": traces.trace_histogram(sp, f, 7200, kept),
        "globals": traces.trace_globals(sp, f, kept), "facets": traces.trace_facets(sp, f, kept=kept), "series": metrics.metric_series(p, W, kept=kept)}


def rounded(df):
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(rows, key=repr)


def test_days_outside_the_range_stay_unread(spark, tables):
    p, lo, sp = read_points(spark, tables), read_telemetry(spark, tables, "logs"), read_telemetry(spark, tables, "spans")
    want = {name: rounded(df) for name, df in answers(p, lo, sp, None).items()}
    assert all(want.values())
    shapes = {name: spark.read.parquet(f"{tables}/{name}").schema for name in ("points", "logs", "spans")}
    spoiled = 0
    for name in shapes:  # the first day holds no table any more, only noise
        for path in glob.glob(f"{tables}/{name}/writer=*/batch=*/event_date={T0.date()}/*.parquet"):
            with open(path, "wb") as out:
                out.write(b"noise")
            spoiled += 1
    assert spoiled
    p, lo, sp = (spark.read.schema(shapes[name]).parquet(f"{tables}/{name}").drop("writer", "batch") for name in ("points", "logs", "spans"))
    with pytest.raises(Exception):
        p.agg(F.sum("value_delta")).collect()
    got = {name: rounded(df) for name, df in answers(p, lo, sp, read_summaries(spark, tables)).items()}
    for name in want:
        assert got[name] == want[name], name


def test_late_points_correct_the_summaries(spark, raw_points, tmp_path):
    rnd, root = random.Random(8), str(tmp_path)
    rows = [{"t": t, "v": v, "a": {"session.id": s}, "m": m} for s in ("a", "b") for m in (CFG.cost_metric, CFG.active_metric)
            for t, v in zip(sorted(rnd.sample(range(3 * DAY), 25)), [float(x) for x in sorted(rnd.choices(range(12), k=25))])]
    every = raw_points(*rows)
    order = list(range(len(rows)))
    rnd.shuffle(order)
    batches = {i: k % 4 for k, i in enumerate(order)}
    marked = every.withColumn("k", F.element_at(F.create_map(*[F.lit(x) for kv in batches.items() for x in kv]), F.col("id").cast("int")))
    for k in range(4):
        merge_points(marked.where(F.col("k") == k).drop("k"), root, k)
    merge_points(marked.where("k = 3").drop("k"), root, 3)  # a batch that is repeated changes nothing
    want = Summaries.of(points=counter_deltas(every)).session_lives()
    got = read_summaries(spark, root).session_lives()
    columns = ("session_id", "cost_usd", "active_time_seconds", "first_any", "first_moved", "last_moved")
    assert listed(got, *columns) == listed(want, *columns)
