"""Checkable queries: ingest, increments, derived columns, report, streams."""

from datetime import date
from itertools import count
from types import SimpleNamespace

from pyspark.sql import functions as F

from spanloom.catalog.base import DAY, W, query
from spanloom.config import utc
from spanloom.functions import expr as E
from spanloom.operators import retention
from spanloom.operators.log_explorer import LogFilter
from spanloom.plans import report
from spanloom.schema import enrich_logs, enrich_points, enrich_spans
from spanloom.sources import compaction, deltas, otlp, tables
from spanloom.streaming import ingest, live, stateful


def _pairs(attrs):
    return F.transform(F.map_entries(attrs), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def _nanos(ts):
    return F.concat(F.unix_micros(ts).cast("string"), F.lit("000"))


def _export(df, outer, scopes, items, item):
    """Rows wrapped as export requests, one row each."""
    scope = F.struct(F.struct(F.col("scope_name").alias("name")).alias("scope"), F.array(item).alias(items))
    resource = F.struct(F.struct(_pairs(F.col("resource_attributes")).alias("attributes")).alias("resource"), F.array(scope).alias(scopes))
    return df.select(F.to_json(F.struct(F.array(resource).alias(outer))).alias("value"))


def exported_logs(t):
    item = F.struct(_nanos("timestamp").alias("observedTimeUnixNano"), F.lit("0").alias("timeUnixNano"), F.lit(0).alias("severityNumber"),
                    F.struct(F.col("body").alias("stringValue")).alias("body"), F.col("trace_id").alias("traceId"), F.upper("span_id").alias("spanId"),
                    _pairs(F.col("attributes")).alias("attributes"))
    return _export(t.logs, "resourceLogs", "scopeLogs", "logRecords", item)


def exported_points(t):
    point = F.struct(_nanos("timestamp").alias("timeUnixNano"), F.col("value_double").alias("asDouble"), F.col("value_long").cast("string").alias("asInt"),
                     _pairs(F.col("attributes")).alias("attributes"))
    item = F.struct(F.col("metric_name").alias("name"), F.col("unit"), F.struct(F.array(point).alias("dataPoints")).alias("sum"))
    return _export(t.points, "resourceMetrics", "scopeMetrics", "metrics", item)


def exported_spans(t):
    item = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name",
                    F.lit(1).alias("kind"), _nanos("start_timestamp").alias("startTimeUnixNano"), _nanos("end_timestamp").alias("endTimeUnixNano"),
                    _pairs(F.col("attributes")).alias("attributes"), F.struct(F.when(F.col("status_code") == "ok", 1).otherwise(2).alias("code")).alias("status"))
    return _export(t.spans, "resourceSpans", "scopeSpans", "spans", item)


_LOG_COLUMNS = ["timestamp", "event_name", "derived_severity", "session_id", "tool", "scope", "trace_id", "span_id", "repository_url", "model", "cost_usd"]
_LOG_SQL = """SELECT epoch_us(ts) AS timestamp, en AS event_name, sev AS derived_severity, sid AS session_id, tool, scope, tr AS trace_id, sp AS span_id,
    repo AS repository_url, model, round(CAST(cost AS DOUBLE), 6) AS cost_usd FROM logs"""
query("flatten_otlp_logs", lambda t: enrich_logs(otlp.flatten_otlp_logs(exported_logs(t))).select(*_LOG_COLUMNS), _LOG_SQL)
query("flatten_otlp_metrics", lambda t: enrich_points(otlp.flatten_otlp_metrics(exported_points(t))).select(
    "metric_name", "unit", "timestamp", "session_id", "model", "token_type", "value_kind", deltas.current_value().alias("value")), """
    SELECT metric AS metric_name, unit, epoch_us(ts) AS timestamp, sid AS session_id, model, tt AS token_type, CASE WHEN is_double THEN 'double' ELSE 'long' END AS value_kind,
      round(cur, 6) AS value FROM points""")
query("flatten_otlp_spans", lambda t: enrich_spans(otlp.flatten_otlp_spans(exported_spans(t))).select(
    "trace_id", "span_id", "parent_span_id", "name", "kind", "start_timestamp", "duration_nanos", "status_code", "total_tokens"), """
    SELECT tr AS trace_id, sp AS span_id, parent AS parent_span_id, name, 'internal' AS kind, epoch_us(st) AS start_timestamp, nanos AS duration_nanos, status AS status_code,
      CAST(ti + tou + tcc + tcr AS DOUBLE) AS total_tokens FROM spans""")


LEVELS = 11


def _deep_logs(t):
    """Every log with one attribute of lists in maps in lists, ``LEVELS`` deep, and quotes and brackets in the string at its bottom."""
    value = F.struct(F.concat("session_id", F.lit(' "'), F.col("id").cast("string"), F.lit('" ]},{[ \\')).alias("stringValue"))
    for i in range(LEVELS):
        if i % 2:
            value = F.struct(F.struct(F.array(value, value).alias("values")).alias("arrayValue")) if i == 1 else F.struct(F.struct(F.array(value).alias("values")).alias("arrayValue"))
        else:
            value = F.struct(F.struct(F.array(F.struct(F.lit(f"k {i}").alias("key"), value.alias("value"))).alias("values")).alias("kvlistValue"))
    item = F.struct(_nanos("timestamp").alias("timeUnixNano"), F.col("span_id").alias("spanId"), value.alias("body"),
                    F.array(F.struct(F.lit("deep").alias("key"), value.alias("value"))).alias("attributes"))
    rows = otlp.flatten_otlp_logs(_export(t.logs, "resourceLogs", "scopeLogs", "logRecords", item))
    return rows.select("timestamp", "span_id", "body", F.col("attributes")["deep"].alias("deep"), F.array_join("nested_attribute_keys", ",").alias("nested_keys"))


def _deep_sql():
    text = """'"' || sid || ' \\"' || id || '\\" ]},{[ \\\\"'"""
    for i in range(LEVELS):
        text = (f"'[' || {text} || ',' || {text} || ']'" if i == 1 else f"'[' || {text} || ']'") if i % 2 else f"""'{{"k {i}":' || {text} || '}}'"""
    return f"SELECT epoch_us(ts) AS timestamp, sp AS span_id, {text} AS body, {text} AS deep, 'deep' AS nested_keys FROM logs"


query("ingest_deep_values", _deep_logs, _deep_sql())
query("enrich_logs", lambda t: t.live.logs.select(*_LOG_COLUMNS), _LOG_SQL)
query("stored_logs", lambda t: t.logs.select(*_LOG_COLUMNS), _LOG_SQL)
query("counter_deltas", lambda t: t.live.points.select("id", "metric_name", "session_id", "timestamp", "value_delta"), """
    SELECT id, metric AS metric_name, sid AS session_id, epoch_us(ts) AS timestamp, round(d, 6) AS value_delta FROM points""")
query("points_moving", lambda t: deltas.points_moving(t.points).select("id", "value_delta"), "SELECT id, round(d, 6) AS value_delta FROM moving")


def _repaired(t):
    """Every third point arrives late; repairing the rest must give the increments of all."""
    late = F.pmod("id", F.lit(3)) == 0
    first = deltas.counter_deltas(t.points.where(~late).drop("value_delta"))
    repairs = deltas.repair_deltas(first, t.points.where(late).drop("value_delta"))
    return deltas.apply_repairs(first, repairs).select("id", "metric_name", "value_delta")


query("repair_deltas", _repaired, "SELECT id, metric AS metric_name, round(d, 6) AS value_delta FROM points")
query("log_expressions", lambda t: t.logs.select(
    "id", E.work_category("attributes").alias("category"), E.mcp_aware_tool("attributes").alias("tool"), E.tool_scope("attributes").alias("scope"),
    E.clean_prompt("prompt", 9).alias("prompt"), E.error_signature(F.coalesce(F.col("attributes")["error"], F.lit(""))).alias("signature"),
    E.safe_json(F.col("attributes")["tool_input"]).isNotNull().alias("has_input"),
    E.attrs_match("attributes", ["success=true", "tool_name=Edit"]).alias("good_edit"),
    E.attrs_match_keyed("attributes", {"model": None, "tool_name": "Bash"}).alias("bash"), E.real_trace_id("trace_id").alias("trace_id")), """
    SELECT id, coalesce(category, 'AUXILIARY') AS category, tool, scope, left(regexp_replace(prompt, '\\s+', ' ', 'g'), 9) AS prompt,
      CASE error WHEN 'command not found' THEN 'command-not-found' WHEN 'timed out' THEN 'timeout' WHEN 'old_string' THEN 'old-string-mismatch' ELSE 'other' END AS signature,
      tn IN ('Edit', 'Read', 'Bash', 'Agent') AND tn IS NOT NULL AS has_input, coalesce(success = 'true' AND tn = 'Edit', FALSE) AS good_edit,
      coalesce(tn = 'Bash', FALSE) AS bash, tr AS trace_id FROM logs""")


def _report(t):
    text = report.report_markdown(t.logs, W)
    rows = [(i, line) for i, line in enumerate(text.split("\n"))]
    return t.spark.createDataFrame(rows, "line_no int, line string")


query("report_markdown", _report)


_RUNS = count()


def _drained(t, stream, name, sink="parquet"):
    """Run a stream over everything stored so far, then read what it wrote."""
    folder = f"{t.root}-streams/{name}-{next(_RUNS)}"
    q = (stream.writeStream.format(sink).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _stream_of(t, table):
    stored = getattr(t, table)
    return t.spark.readStream.schema(t.spark.read.parquet(f"{t.root}/{table}").schema).option("maxFilesPerTrigger", 10_000).parquet(f"{t.root}/{table}").select(*stored.columns)


def _live_histogram(t):
    """Every bin of the stored rows: append mode would hold back those the watermark has not passed. A row per bin of the range reaches the driver."""
    number = next(_RUNS)
    q = (live.live_histogram(_stream_of(t, "logs"), LogFilter(W), DAY, "0 seconds").writeStream.format("memory").queryName(f"live_histogram_{number}")
         .option("checkpointLocation", f"{t.root}-streams/histogram-{number}/checkpoint").outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.table(f"live_histogram_{number}")


# The twin of stream_log_histogram ends before 30 January; stream_log_histogram_all is the whole result.
query("stream_log_histogram_all", _live_histogram, """
    SELECT epoch_us(date_trunc('day', ts)) AS bucket, count(*) FILTER (sev = 'ERROR') AS error_count, count(*) FILTER (sev = 'WARN') AS warn_count,
      count(*) FILTER (sev = 'INFO') AS info_count, count(*) FILTER (sev = 'DEBUG') AS debug_count FROM logs GROUP BY 1""")
query("stream_log_histogram", lambda t: _live_histogram(t).where("bucket < timestamp'2024-01-30'"), """
    SELECT epoch_us(date_trunc('day', ts)) AS bucket, count(*) FILTER (sev = 'ERROR') AS error_count, count(*) FILTER (sev = 'WARN') AS warn_count,
      count(*) FILTER (sev = 'INFO') AS info_count, count(*) FILTER (sev = 'DEBUG') AS debug_count FROM logs WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1""")


def _live_deltas(t):
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    try:
        out = _drained(t, stateful.stream_deltas(_stream_of(t, "points"), lateness_seconds=90 * DAY), "deltas")
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.select("id", "value_delta", "change")


query("stream_counter_deltas", _live_deltas, "SELECT id, round(d, 6) AS value_delta, 'insert' AS change FROM points")
PARTS = 3


def _ingested_in_parts(t):
    """All points as export files that come in three parts, every third point each, so most rows of the later ones are late."""
    folder = f"{t.root}-streams/ingest-{next(_RUNS)}"
    for part in range(PARTS):
        exported_points(SimpleNamespace(points=t.points.where(F.pmod("id", F.lit(PARTS)) == part))).write.mode("append").text(f"{folder}/source")
        ingest.ingest_exports(t.spark, f"{folder}/source", f"{folder}/tables", "points", f"{folder}/checkpoint").awaitTermination()
    return tables.read_points(t.spark, f"{folder}/tables").select("metric_name", "session_id", "timestamp", "model", "token_type", "value_delta")


query("ingest_stream_points", _ingested_in_parts,
      "SELECT metric AS metric_name, sid AS session_id, epoch_us(ts) AS timestamp, model, tt AS token_type, round(d, 6) AS value_delta FROM points")


def _compacted(t):
    """Points that come in parts, every third each; closed days are rewritten after two parts and again after the last."""
    folder = f"{t.root}-streams/compacted-{next(_RUNS)}/tables"
    for part in range(PARTS):
        ingest.merge_points(t.points.where(F.pmod("id", F.lit(PARTS)) == part), folder, part)
        if part:
            tables.compact(t.spark, folder, "points", date(2024, 1, 28))
        for table in ("points", "point_fixes"):
            compaction.vacuum(t.spark, folder, table)
    return tables.read_points(t.spark, folder).select("id", "metric_name", "value_delta")


query("compacted_points", _compacted, "SELECT id, metric AS metric_name, round(d, 6) AS value_delta FROM points")


def _purged_between(t):
    """Points to the noon after the cutoff are ingested, old days are purged in place, and the rest comes in afterwards."""
    folder, noon = f"{t.root}-streams/purged-{next(_RUNS)}/tables", F.lit("2024-01-30 12:00:00").cast("timestamp")
    tables.write_telemetry(t.logs, folder, "logs", 0)
    tables.write_telemetry(t.spans, folder, "spans", 0)
    ingest.merge_points(t.points.where(F.col("timestamp") < noon), folder, 0)
    retention.purge_days(t.spark, folder, utc("2024-01-30"))
    ingest.merge_points(t.points.where(F.col("timestamp") >= noon), folder, 1)
    return tables.read_points(t.spark, folder).select("id", "metric_name", "session_id", "value_delta")


query("purge_then_ingest", _purged_between, """
    WITH early AS (SELECT * FROM points WHERE ts < TIMESTAMP '2024-01-30 12:00:00'),
    dorm AS (SELECT sid FROM (SELECT sid, ts FROM early UNION ALL SELECT sid, ts FROM logs UNION ALL SELECT sid, st FROM spans) GROUP BY sid HAVING max(ts) < TIMESTAMP '2024-01-30'),
    newest AS (SELECT arg_max(id, (ts, id)) AS id FROM early GROUP BY stream)
    SELECT id, metric AS metric_name, sid AS session_id, round(d, 6) AS value_delta FROM points
    WHERE NOT (ts < TIMESTAMP '2024-01-30' AND sid IN (SELECT sid FROM dorm) AND id NOT IN (SELECT id FROM newest))""")


def _late_points(t):
    """Points that are stored part by part without an increment, and a stream that works the increments out; two days late at most, or repaired."""
    folder = f"{t.root}-streams/late-{next(_RUNS)}"
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    try:
        for part in range(PARTS):
            raw = t.points.where(F.pmod("id", F.lit(PARTS)) == part).withColumn("value_delta", F.lit(None).cast("double"))
            tables.write_telemetry(raw, f"{folder}/tables", "points", part)
            ingest.stream_increments(t.spark, f"{folder}/tables", f"{folder}/checkpoint", lateness_seconds=2 * DAY).awaitTermination()
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return f"{folder}/tables"


query("stream_late_points", lambda t: tables.read_points(t.spark, _late_points(t)).select("id", "metric_name", "value_delta"),
      "SELECT id, metric AS metric_name, round(d, 6) AS value_delta FROM points")
query("stream_late_sessions", lambda t: tables.read_summaries(t.spark, _late_points(t)).session_lives().select("session_id", "cost_usd", "first_moved", "last_moved"), """
    SELECT sid AS session_id, round(coalesce(sum(d) FILTER (metric LIKE '%cost%'), 0), 6) AS cost_usd, epoch_us(min(ts) FILTER (d <> 0)) AS first_moved,
      epoch_us(max(ts) FILTER (d <> 0)) AS last_moved FROM points WHERE metric LIKE '%cost%' OR metric LIKE '%active%' GROUP BY sid""")
query("stream_live_tail", lambda t: _drained(t, live.live_tail(_stream_of(t, "logs"), LogFilter(W, tools=("Bash",)), (W.start, -1)).select("id", "timestamp", "tool"), "tail"),
      "SELECT id, epoch_us(ts) AS timestamp, tool FROM logs WHERE tn = 'Bash'")
