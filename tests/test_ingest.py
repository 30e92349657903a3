from datetime import datetime, timezone
import json
import os
import random

from conftest import T0, HOUR, at, listed
from pyspark.sql import functions as F
import pytest

from spanloom import catalog
from spanloom.operators.retention import purge_tables
from spanloom.config import CFG
from spanloom.operators.log_explorer import LogFilter, attribute_pairs, log_histogram
from spanloom.plans.report import report_markdown
from spanloom.schema import LOG_SCHEMA, enrich_logs, enrich_points, enrich_spans
from spanloom.sources import adapter, otlp
from spanloom.sources.tables import read_points, read_telemetry, stored
from spanloom.streaming import ingest, live

NS = int(T0.timestamp()) * 10**9


def kv(**values):
    return [{"key": k.replace("__", "."), "value": v} for k, v in values.items()]


def s(text):
    return {"stringValue": text}


def lines(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def log_export(*records, resource=()):
    return {"resourceLogs": [{"resource": {"attributes": list(resource)}, "scopeLogs": [{"scope": {"name": "sc"}, "logRecords": list(records)}]}]}


def test_logs_fall_back_to_the_observed_time(spark):
    doc = log_export({"observedTimeUnixNano": str(NS + 5), "severityNumber": 0, "severityText": "", "body": s("hi"), "traceId": "AB", "spanId": "",
                      "attributes": kv(event__name=s("api_error"))},
                     {"timeUnixNano": NS + 1_999, "observedTimeUnixNano": str(NS), "severityNumber": 9}, resource=kv(vcs__repository__url__full=s("r")))
    a, b = enrich_logs(otlp.flatten_otlp_logs(lines(spark, doc, "not json", "{}"))).orderBy("timestamp").collect()
    assert (a.severity_number, a.severity_text, a.trace_id, a.span_id, a.body, a.scope_name) == (None, None, "ab", None, "hi", "sc")
    assert (a.derived_severity, a.repository_url, b.derived_severity) == ("ERROR", "r", "INFO")
    assert (b.timestamp - a.timestamp).microseconds == 1


def test_values_of_every_kind(spark):
    nested = {"kvlistValue": {"values": kv(n={"arrayValue": {"values": [{"intValue": "1"}, s('q"t'), {}]}}, b={"boolValue": True})}}
    doc = log_export({"timeUnixNano": NS, "attributes": kv(a=s("x"), i={"intValue": "7"}, d={"doubleValue": 1.5}, f={"boolValue": False}, e={}, n=nested)
                      + kv(a=s("last"))})
    row = otlp.flatten_otlp_logs(lines(spark, doc)).first()
    assert {k: v for k, v in row.attributes.items() if k != "n"} == {"a": "last", "i": "7", "d": "1.5", "f": "false", "e": None}
    assert json.loads(row.attributes["n"]) == {"n": [1, 'q"t', None], "b": True}
    pairs = attribute_pairs(enrich_logs(otlp.flatten_otlp_logs(lines(spark, doc))), LogFilter())
    assert listed(pairs, "pair") == [("a=last",), ("d=1.5",), ("f=false",), ("i=7",)]


def test_a_replayed_export_has_the_same_ids(spark):
    doc = log_export({"timeUnixNano": NS, "body": s("x")}, {"timeUnixNano": NS, "body": s("y")})
    ids = lambda: {r.id for r in otlp.flatten_otlp_logs(lines(spark, doc)).collect()}
    assert ids() == ids() and len(ids()) == 2


def metric_export(*values, name=CFG.cost_metric, kind="sum"):
    points = [{"timeUnixNano": str(NS + t * 10**9), "startTimeUnixNano": str(NS), "asDouble": v, "attributes": kv(session__id=s("s"))} for t, v in values]
    return {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": name, "unit": "USD", kind: {"dataPoints": points}}]}]}]}


def test_only_number_points(spark):
    whole = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "w", "gauge": {"dataPoints": [{"timeUnixNano": str(NS), "asInt": "5"}, {"timeUnixNano": str(NS)}]}}]}]}]}
    rows = otlp.flatten_otlp_metrics(lines(spark, metric_export((0, 1.5)), whole, metric_export((0, 1), name="h", kind="histogram")))
    assert listed(rows, "metric_name", "value_double", "value_long", "value_kind") == [
        (CFG.cost_metric, 1.5, None, "double"), ("w", None, 5, "long"), ("w", None, None, "unknown")]
    assert enrich_points(rows).where("session_id = 's'").count() == 1


def test_spans(spark):
    span = {"traceId": "0A", "spanId": "1", "parentSpanId": "", "name": "n", "kind": 3, "startTimeUnixNano": str(NS), "endTimeUnixNano": str(NS + 1500),
            "status": {"code": 2, "message": ""}, "events": [{"name": "ev", "timeUnixNano": str(NS), "attributes": kv(a=s("b"))}]}
    other = {"traceId": "0a", "spanId": "2", "name": "m", "kind": "SPAN_KIND_SERVER", "startTimeUnixNano": str(NS), "endTimeUnixNano": str(NS)}
    doc = {"resourceSpans": [{"scopeSpans": [{"spans": [span, other]}]}]}
    a, b = enrich_spans(otlp.flatten_otlp_spans(lines(spark, doc))).orderBy("span_id").collect()
    assert (a.trace_id, a.parent_span_id, a.kind, a.duration_nanos, a.status_code, a.status_message) == ("0a", None, "client", 1500, "error", None)
    assert a.events[0].name == "ev" and a.events[0].attributes == {"a": "b"}
    assert (b.kind, b.status_code, b.events) == ("server", None, None)


def drain(spark, source, root, table, checkpoint, *docs, name):
    source.mkdir(exist_ok=True)
    (source / name).write_text("\n".join(json.dumps(d) for d in docs))
    ingest.ingest_exports(spark, str(source), root, table, checkpoint).awaitTermination()


def test_export_files_become_tables(spark, tmp_path):
    root, cp = str(tmp_path / "root"), str(tmp_path / "cp")
    drain(spark, tmp_path / "in", root, "logs", cp, log_export({"timeUnixNano": NS, "body": s("x"), "attributes": kv(event__name=s("e"))}), name="a.json")
    drain(spark, tmp_path / "in", root, "logs", cp, log_export({"timeUnixNano": NS + 10**9, "body": s("y")}), name="b.json")
    assert listed(read_telemetry(spark, root, "logs"), "body", "event_name") == [("x", "e"), ("y", None)]


def test_unreadable_requests_are_kept_with_the_reason(spark, tmp_path):
    good = log_export({"timeUnixNano": str(NS), "body": s("x")})
    docs = [good, "not json", "{}", '{"resourceLogs": "text"}', " "]
    found = otlp.rejected_exports(lines(spark, *docs), "logs")
    wanted = [("not json", "not JSON"), ('{"resourceLogs": "text"}', "partly unreadable"), ("{}", "no resourceLogs")]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
    ingest.ingest_exports(spark, str(source), str(tmp_path / "t"), "logs", str(tmp_path / "c")).awaitTermination()
    assert read_telemetry(spark, str(tmp_path / "t"), "logs").count() == 1
    assert sorted(listed(spark.read.parquet(str(tmp_path / "t/rejected")), "value", "reason")) == sorted(wanted)


def test_late_metric_files_repair_stored_increments(spark, tmp_path):
    root, cp = str(tmp_path / "root"), str(tmp_path / "cp")
    day = 86_400
    drain(spark, tmp_path / "in", root, "points", cp, metric_export((0, 100.0), (3 * day, 400.0)), name="a.json")
    drain(spark, tmp_path / "in", root, "points", cp, metric_export((day, 250.0)), name="b.json")
    stored = read_points(spark, root).orderBy("timestamp")
    assert [r.value_delta for r in stored.collect()] == [100.0, 150.0, 150.0]


def test_writers_do_not_replace_each_other(spark, tmp_path):
    root = str(tmp_path / "root")
    drain(spark, tmp_path / "in1", root, "points", str(tmp_path / "cp1"), metric_export((0, 100.0)), name="a.json")
    drain(spark, tmp_path / "in2", root, "points", str(tmp_path / "cp2"), metric_export((60, 130.0)), name="a.json")
    assert [r.value_delta for r in read_points(spark, root).orderBy("timestamp").collect()] == [100.0, 30.0]


def test_equal_points_of_two_hosts_are_two(spark):
    docs = []
    for host in "ab":
        doc = metric_export((0, 1.5))
        doc["resourceMetrics"][0]["resource"] = {"attributes": kv(host=s(host))}
        docs.append(doc)
    rows = otlp.flatten_otlp_metrics(lines(spark, *docs, docs[0])).select("id").collect()
    assert len(rows) == 3 and len({r.id for r in rows}) == 2


def test_purged_tables_take_points_again(spark, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    drain(spark, tmp_path / "in", old, "points", str(tmp_path / "cp"), metric_export((0, 100.0)), name="a.json")
    for name, doc in (("logs", log_export({"timeUnixNano": NS, "body": s("x")})), ("spans", {"resourceSpans": [{"scopeSpans": [{"spans": [
            {"traceId": "0a", "spanId": "1", "name": "n", "startTimeUnixNano": str(NS), "endTimeUnixNano": str(NS)}]}]}]})):
        drain(spark, tmp_path / f"in-{name}", old, name, str(tmp_path / f"cp-{name}"), doc, name="a.json")
    purge_tables(spark, old, new, datetime.fromtimestamp(NS / 1e9 - 86_400, timezone.utc))
    drain(spark, tmp_path / "in", new, "points", str(tmp_path / "cp-new"), metric_export((0, 100.0), (60, 150.0)), name="b.json")
    assert [r.value_delta for r in read_points(spark, new).orderBy("timestamp").collect()] == [100.0, 50.0]


def test_live_histogram_equals_the_batch_one(spark, logs, tmp_path):
    rows = logs(*[{"ev": e, "t": t} for e, t in (("api_error", 0), ("x", 59), ("x", 60), ("compaction", 500), ("x", 900), ("x", 3600))])
    rows.write.parquet(str(tmp_path / "in"))
    f = LogFilter(HOUR)
    stream = live.live_histogram(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), f, 600, "0 seconds")
    q = stream.writeStream.format("memory").queryName("live_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = log_histogram(rows, f, 600).where("error_count + warn_count + info_count + debug_count > 0")
    assert listed(spark.table("live_counts"), *batch.columns) == listed(batch, *batch.columns)


def test_registered_live_histogram_has_every_row(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    bins = catalog.queries()["stream_log_histogram_all"](spark, folder).collect()
    days = {r[0]: r[1] for r in stored(spark, folder).logs.groupBy(F.unix_micros(F.date_trunc("day", "timestamp"))).count().collect()}
    assert {r.bucket: r.error_count + r.warn_count + r.info_count + r.debug_count for r in bins} == days
    assert max(days) >= datetime(2024, 1, 30, tzinfo=timezone.utc).timestamp() * 1e6


def test_live_tail(spark, logs, tmp_path):
    rows = logs(*[{"ev": "x", "t": t} for t in (0, 5, 5, 9)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.live_tail(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), LogFilter(), (at(5), 1)).select("id")
    stream.writeStream.format("memory").queryName("tail").trigger(availableNow=True).start().awaitTermination()
    assert listed(spark.table("tail"), "id") == [(2,), (3,)]


def test_report_words_its_findings(logs):
    def call(tool, t, ok=True, **a):
        given = a.pop("given", {})
        return {"ev": "tool_result", "t": t, "a": {"tool_name": tool, "session.id": "session-1234", "success": str(ok).lower(), "tool_input": json.dumps(given), **a}}

    rows = logs(*[call("Bash", i, given={"command": "cd a && cat x"}, duration_ms="6000", tool_result_size_bytes="30000") for i in range(10)],
                *[call("Read", i, given={"file_path": "/hunt"}) for i in range(4)], call("Read", 50, ok=False, given={"file_path": "/humt"}, error="does not exist"),
                *[call("Edit", 60 + i, ok=False, given={"file_path": "/hunt"}) for i in range(2)])
    text = report_markdown(rows, HOUR)
    for title in ("Failures", "Path near-misses", "Redundant reads", "Edit failure loops", "Suggestions", "Shell command hotspots", "Tool performance",
                  "Tool call mix", "Context footprint", "Oversized results"):
        assert f"## {title}" in text
    assert "10 of 10 shell commands begin with `cd`" in text
    bullet = [x for x in text.split("\n") if x.startswith("- `/hunt`")]
    assert len(bullet) == 1 and "read 4 times" in bullet[0] and "Edits of it also failed 2 times" in bullet[0]
    assert [x for x in text.split("\n") if x.startswith("- Shell command `cat`") and "use `Read` instead" in x and "One call took 6000 ms" in x]
    assert "session-…" in text and "| missing-path |" in text
    assert "No tool results" in report_markdown(rows.limit(0), HOUR)


def test_shapes_have_no_surprises():
    assert [f.name for f in LOG_SCHEMA.fields][:2] == ["id", "timestamp"]


def wrapped(value):
    """A plain value in the protocol's JSON form."""
    if value is None:
        return {}
    if isinstance(value, bool):
        return {"boolValue": value}
    if isinstance(value, int):
        return {"intValue": str(value)}
    if isinstance(value, float):
        return {"doubleValue": value}
    if isinstance(value, str):
        return {"stringValue": value}
    if isinstance(value, list):
        return {"arrayValue": {"values": [wrapped(v) for v in value]} if value else {}}
    return {"kvlistValue": {"values": [{"key": k, "value": wrapped(v)} for k, v in value.items()]} if value else {}}


def deep(rnd, depth):
    strings = ["plain", 'q"uote', "back\\slash\\", "{\"stringValue\":\"x\"}", "[1,{2}]", "a: b, c", "line\nbreak\ttab", "é 𝒳 \u2028", "", '\\"', "}]}", "\x7f"]
    if depth == 0:
        return rnd.choice([None, True, False, 7, -(2 ** 62), 1.5, *strings])
    if rnd.random() < 0.5:
        return [deep(rnd, rnd.randrange(depth)) for _ in range(rnd.randrange(4))] + [deep(rnd, depth - 1)]
    return {rnd.choice(strings) + str(i): deep(rnd, rnd.randrange(depth)) for i in range(rnd.randrange(3))} | {"last": deep(rnd, depth - 1)}


def test_values_of_any_depth(spark):
    rnd = random.Random(6)
    values = [deep(rnd, d) for d in [1, 2, 3, 5, 9, 12] * 12] + [[], {}, [[]], [{}], {"a": {}}, {"a": []}, [None], {"a": None}]
    tall = "bottom"
    for i in range(60):
        tall = [tall] if i % 2 else {"k": tall}
    values += [tall, ["x" * 50_000 + '\\"' * 5_000], list(range(3000))]
    rows = [(i, json.dumps({"key": "v", "value": wrapped(v)}, ensure_ascii=i % 2 == 0, indent=2 if i % 3 == 0 else None)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, value string")
    pair = F.from_json("value", f"struct<key: string, value: {otlp._VALUE}>")
    got = {r.i: r.t for r in df.select("i", otlp.any_text(pair["value"]).alias("t")).collect()}
    for i, v in enumerate(values):
        if isinstance(v, (list, dict)):
            assert json.loads(got[i]) == v, v
    assert got[len(values) - 1] == "[" + ",".join(map(str, range(3000))) + "]"


def test_events_of_one_row_group_are_mapped_by_several_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 60) AS ts", "id % 7 AS user_id",
                                       "element_at(array('click', 'view', 'error', 'purchase', 'signup'), CAST(id % 5 AS INT) + 1) AS event_type",
                                       "CAST(id AS DOUBLE) AS value", "concat('{\"k\": ', id % 100, '}') AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    events = adapter.read_events(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (adapter.event_logs(events), adapter.event_spans(events)):
            sizes = df.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
            assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 400
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_text_of_the_protocols_form_is_marked_whole_and_spoilt_text_stays(spark):
    value = {"a": [{"b": "]}},{[ x"}, [], {}, 7, None], "c": {"d": ["e"]}}
    text = json.dumps(wrapped(value), separators=(",", ":"))
    df = spark.createDataFrame([(text, "{\"kvlistValue\":{\"values\":[]}}}")], "w string, spoilt string")
    row = df.select(otlp._well_formed(otlp._marked(F.col("w"))).alias("whole"), otlp.plain_json(F.col("w")).alias("t"), otlp.plain_json(F.col("spoilt")).alias("s")).first()
    assert row.whole and json.loads(row.t) == value and row.s == "{}}"


def test_random_nested_values_are_read_whole(spark):
    rnd = random.Random(2)

    def made(depth):
        kind = rnd.randrange(6) if depth else rnd.randrange(3)
        if kind < 3:
            return ({"stringValue": "a {\"]:"}, 'a {"]:') if kind == 0 else ({"intValue": "5"}, 5) if kind == 1 else ({"boolValue": True}, True)
        some = [made(depth - 1) for _ in range(rnd.randrange(3))]
        if kind == 3:
            return {"arrayValue": {"values": [w for w, _ in some]}}, [v for _, v in some]
        pairs = [({"key": f"k{i}", "value": w} if rnd.randrange(2) else {"value": w, "key": f"k{i}"}) for i, (w, _) in enumerate(some)]
        return {"kvlistValue": {"values": [*pairs, {"key": "bare"}]}}, {**{f"k{i}": v for i, (_, v) in enumerate(some)}, "bare": None}

    values = [v for v in (made(5) for _ in range(200)) if "arrayValue" in v[0] or "kvlistValue" in v[0]]
    df = spark.createDataFrame([(i, json.dumps(w, indent=rnd.choice([None, 1]))) for i, (w, _) in enumerate(values)], "i int, w string")
    got = {r.i: json.loads(r.t) for r in df.select("i", otlp.plain_json(F.col("w")).alias("t")).collect()}
    assert got == {i: v for i, (_, v) in enumerate(values)}
