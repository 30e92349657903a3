"""Trends, local calendar days, and retention."""

from datetime import date, datetime, timedelta, timezone

from conftest import HOUR, at, listed
from pyspark.sql import functions as F

from spanloom.config import CFG, TimeRange, utc
from spanloom.operators import metrics, retention, trends, usage_calendar
from spanloom.sources import compaction
from spanloom.sources.summaries import Summaries
from spanloom.sources.tables import read_points, read_summaries, read_telemetry, write_telemetry
from spanloom.streaming.ingest import merge_points

BERLIN = "Europe/Berlin"


def on(text):
    return (datetime.fromisoformat(text).replace(tzinfo=timezone.utc) - datetime(2024, 3, 1, tzinfo=timezone.utc)).total_seconds()


def test_prior_period_ends_before_this_one(points):
    rows = points({"v": 1, "t": -3600, "a": {"session.id": "a"}}, {"v": 2, "t": -1, "a": {"session.id": "b"}}, {"v": 4, "t": 0, "a": {"session.id": "c"}},
                  {"v": 8, "t": 3600, "a": {"session.id": "d"}}, {"v": 16, "t": 3601, "a": {"session.id": "e"}})
    r = [x for x in trends.totals_current_prior(rows, HOUR).collect() if x.row_type == "cost"][0]
    assert (r.current_total, r.prior_total) == (12.0, 3.0)
    assert listed(trends.sessions_current_prior(rows, HOUR), "period", "session_count") == [("current", 2), ("prior", 2)]


def test_nothing_before_is_a_full_rise_and_never_divides_by_zero(points, logs):
    rows = points({"v": 4, "t": 5})
    got = {r.metric: r for r in trends.trends(rows, logs({"ev": "x"}), HOUR).collect()}
    assert len(got) == 11
    assert (got["total_cost"].before, got["total_cost"].delta, got["total_cost"].verdict) == (0.0, 100.0, "bad")
    assert (got["blended_rate_per_1m"].after, got["error_rate_pct"].verdict) == (0.0, "flat")
    assert got["sessions"].verdict == "good"


def test_a_session_in_both_periods_counts_in_both(points):
    rows = points({"v": 1, "t": -10}, {"v": 2, "t": 10})
    assert listed(trends.sessions_current_prior(rows, HOUR), "period", "session_count", "avg_duration_seconds") == [("current", 1, 20.0), ("prior", 1, 20.0)]


def test_late_bins_clamp_in_series_and_drop_in_trends(points, logs):
    w = TimeRange(at(0), at(1000))
    rows = points({"v": 1, "t": 0}, {"v": 3, "t": 1000})
    series = {r.bucket_index: r.total for r in metrics.metric_series_trend(rows, w, [CFG.cost_metric], bins=24).collect()}
    assert series[0] == 1.0 and series[23] == 2.0 and len(series) == 24
    kept = trends.trend_series(rows, logs({"ev": "x"}), w, "cost").where("metric = 'total_cost' AND period = 'current'")
    assert kept.agg(F.sum("value")).first()[0] == 1.0


def test_local_days_around_the_clock_change(points):
    """Berlin sets clocks back on 2024-10-27: the day has 25 hours and hour 2 comes twice."""
    rows = points(*[{"v": v, "t": on(t), "a": {"session.id": t}} for v, t in (
        (1, "2024-10-26T21:59:59"), (2, "2024-10-26T22:00:00"), (4, "2024-10-27T00:30:00"), (8, "2024-10-27T01:30:00"), (16, "2024-10-27T22:59:59"),
        (32, "2024-10-27T23:00:00"))])
    w = TimeRange(utc("2024-10-26T00:00:00"), utc("2024-10-29T00:00:00"))
    assert listed(usage_calendar.daily_counters(rows, w, BERLIN), "day", "cost_usd") == [("2024-10-26", 1.0), ("2024-10-27", 30.0), ("2024-10-28", 32.0)]
    hours = {(r.day, r.hour): r.cost_usd for r in usage_calendar.hourly_counters(rows, w, BERLIN).collect()}
    assert hours[("2024-10-27", 2)] == 12.0


def test_calendar_has_every_day(points, logs):
    rows = points({"v": 3, "t": on("2024-10-26T10:00:00")})
    days = usage_calendar.usage_calendar(rows, logs({"ev": "x"}), TimeRange(utc("2024-10-25"), utc("2024-10-28")), date(2024, 10, 25), date(2024, 10, 27), "UTC")
    assert [(r.day, r.cost_usd) for r in days.collect()] == [("2024-10-25", 0.0), ("2024-10-26", 3.0), ("2024-10-27", 0.0)]
    assert listed(usage_calendar.calendar_heat(days, "2024-10-27"), "day", "heat_percent") == [("2024-10-26", 6.0)]
    t = usage_calendar.period_totals(days, "2024-10-26").first()
    assert (t.active_days, t.elapsed_days) == (1, 2)
    change = usage_calendar.period_change(days.where("day > '2024-10-25'"), days.where("day = '2024-10-25'"), "2024-10-27").first()
    assert change.cost_usd_change_percent is None


def stores(logs, points, spans):
    s = lambda x: {"a": {"session.id": x}}
    return (logs({"ev": "x", "t": 0, **s("dead")}, {"ev": "x", "t": 0, **s("split")}, {"ev": "x", "t": 0}, {"ev": "x", "t": 900}),
            points({"v": 1, "t": 0, **s("dead")}, {"v": 2, "t": 1, **s("dead")}, {"v": 3, "t": 0, **s("live")}, {"v": 4, "t": 900, **s("live")}),
            spans({"tr": "a", "t": 0, **s("dead")}, {"tr": "b", "t": 900, **s("split")}))


def test_purge_keeps_live_sessions_and_stream_markers(logs, points, spans):
    tables = stores(logs, points, spans)
    cut = at(500)
    assert listed(retention.dormant_sessions(*tables, cut), "session_id") == [("dead",)]
    kept = retention.purge(*tables, cut)
    assert listed(kept["log_records"], "id") == [(1,), (3,)]
    # The newest point of a dormant stream stays as its marker.
    assert listed(kept["metric_points"], "id") == [(1,), (2,), (3,)]
    assert listed(kept["spans"], "trace_id") == [("b",)]


def test_preview_equals_purge(logs, points, spans):
    tables = stores(logs, points, spans)
    preview = {r.table_name: r for r in retention.purge_preview(*tables, at(500), {"spans": 1000}).collect()}
    kept = retention.purge(*tables, at(500))
    for name, before in zip(("log_records", "metric_points", "spans"), tables):
        assert preview[name].rows_to_delete == before.count() - kept[name].count()
    assert preview["spans"].estimated_bytes == 500 and preview["log_records"].preserved_rows == 1


def test_orphaned_analyses_go(spark, logs, points, spans):
    analyses = spark.createDataFrame([("a",), ("b",)], "trace_id string")
    assert listed(retention.purge(*stores(logs, points, spans), at(500), analyses)["trace_analyses"], "trace_id") == [("b",)]


def test_purged_tables_are_a_new_version(spark, logs, points, spans, tmp_path):
    for name, df in zip(("logs", "points", "spans"), stores(logs, points, spans)):
        write_telemetry(df, str(tmp_path / "v1"), name, 0)
        write_telemetry(df, str(tmp_path / "v1"), name, 0)
    retention.purge_tables(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), at(500))
    count = lambda v, t: read_telemetry(spark, str(tmp_path / v), t).count()
    assert [(count("v1", t), count("v2", t)) for t in ("logs", "points", "spans")] == [(4, 2), (4, 3), (2, 1)]


def test_purge_in_place_rewrites_only_days_that_lose_rows(spark, logs, points, spans, raw_points, tmp_path):
    root, day = str(tmp_path), 86_400
    line = raw_points(*[{"t": i * 6 * 3600, "v": float(i % 5), "a": {"session.id": f"s{i // 12}"}} for i in range(36)])
    parts = [line.where(F.pmod("id", F.lit(2)) == k) for k in (0, 1)]
    for k, part in enumerate(parts):
        merge_points(part, root, k)
    sessions = lambda i: {"a": {"session.id": f"s{i}"}}
    write_telemetry(logs({"ev": "x", "t": 10, **sessions(0)}, {"ev": "x", "t": 4 * day, **sessions(1)}, {"ev": "x", "t": 20}), root, "logs", 0)
    write_telemetry(spans({"s": "1", "t": 10, **sessions(0)}, {"s": "2", "t": 4 * day, **sessions(1)}), root, "spans", 0)
    stored = (read_telemetry(spark, root, "logs"), read_points(spark, root), read_telemetry(spark, root, "spans"))
    cut = at(5 * day + 3600)
    want = {n: listed(df, "id") for n, df in retention.purge(*stored, cut).items()}
    deltas = {r.id: r.value_delta for r in stored[1].collect()}
    untouched = [p for p in compaction.places(spark, root, "points") if p[-10:] > str(cut.date())]
    done = retention.purge_days(spark, root, cut)
    assert done["points"] and max(done["points"]) <= str(cut.date())
    now = {"log_records": read_telemetry(spark, root, "logs"), "metric_points": read_points(spark, root), "spans": read_telemetry(spark, root, "spans")}
    assert {n: listed(df, "id") for n, df in now.items()} == want and 0 < len(want["metric_points"]) < 36
    assert all(deltas[r.id] == r.value_delta for r in now["metric_points"].collect())
    assert set(untouched) <= set(compaction.places(spark, root, "points")) - set(compaction.replaced(spark, root, "points"))
    assert retention.purge_days(spark, root, cut) == {"logs": [], "points": [], "spans": []}
    kept, derived = read_summaries(spark, root), Summaries.of(now["metric_points"], now["spans"], now["log_records"])
    assert listed(kept.session_lives(), "session_id", "cost_usd") == listed(derived.session_lives(), "session_id", "cost_usd")
    for table in ("points", "spans", "logs", "point_heads", "session_days"):
        compaction.vacuum(spark, root, table)
    assert listed(read_points(spark, root), "id") == want["metric_points"]
    merge_points(raw_points({"t": 36 * 6 * 3600, "v": 7.0, "a": {"session.id": "s2"}}), root, 2)
    assert read_points(spark, root).orderBy(F.desc("timestamp")).first().value_delta == 7.0 - 35 % 5


def test_freshness(logs, points, spans):
    received = lambda s: {"received_at": at(s)}
    rows = (logs({"ev": "a", "t": 0, **received(0)}), points({"v": 1, "t": 0, **received(0)}), spans({"t": 0, **received(0)}).limit(0))
    got = {r.signal: r.freshness for r in retention.ingest_health(*rows, at(600)).collect()}
    assert got == {"logs": "live", "metrics": "live", "traces": "empty"}
    later = {r.signal: r.freshness for r in retention.ingest_health(*rows, at(600) + timedelta(days=2)).collect()}
    assert later["logs"] == "stale"
