"""OTLP/JSON export requests (one per line) as table rows.

Input is a DataFrame, batch or streaming, with a string column ``value``. Text
that does not parse yields no rows; ``rejected_exports`` gives it with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.expr import blank_to_null, number

# Protocol numbers and names of kinds and codes.
SPAN_KINDS = {1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}
STATUS_CODES = {1: "ok", 2: "error"}


# A list or map is read as the JSON text it was sent as, so that no depth is lost.
_VALUE = "struct<stringValue: string, boolValue: string, intValue: string, doubleValue: string, bytesValue: string, arrayValue: string, kvlistValue: string>"
_ATTRS = f"array<struct<key: string, value: {_VALUE}>>"
_HEAD = f"resource: struct<attributes: {_ATTRS}>"
_SCOPE = f"scope: struct<name: string, attributes: {_ATTRS}>"
_NUMBER_POINTS = (f"struct<dataPoints: array<struct<timeUnixNano: string, startTimeUnixNano: string, asDouble: string, asInt: string, "
                  f"attributes: {_ATTRS}>>>")
_LOGS = (f"resourceLogs array<struct<{_HEAD}, scopeLogs: array<struct<{_SCOPE}, logRecords: array<struct<timeUnixNano: string, "
         f"observedTimeUnixNano: string, severityNumber: string, severityText: string, body: {_VALUE}, traceId: string, "
         f"spanId: string, attributes: {_ATTRS}>>>>>>")
_METRICS = (f"resourceMetrics array<struct<{_HEAD}, scopeMetrics: array<struct<{_SCOPE}, metrics: array<struct<name: string, unit: string, "
            f"description: string, sum: {_NUMBER_POINTS}, gauge: {_NUMBER_POINTS}>>>>>>")
_SPANS = (f"resourceSpans array<struct<{_HEAD}, scopeSpans: array<struct<{_SCOPE}, spans: array<struct<traceId: string, spanId: string, "
          f"parentSpanId: string, name: string, kind: string, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {_ATTRS}, "
          f"status: struct<code: string, message: string>, events: array<struct<name: string, timeUnixNano: string, attributes: {_ATTRS}>>>>>>>>")


# Stand-ins, none of which can occur in JSON text: for an escaped backslash and quote, for the punctuation inside
# strings, and for the brackets of values that are done.
_ESCAPES = (("\\\\", "\x01"), ('\\"', "\x02"))
_PUNCTUATION, _HIDDEN = "{}[],:", "\x03\x04\x05\x06\x0e\x0f"
_DONE = {"[": "\x10", "]": "\x11", "{": "\x12", "}": "\x13"}
_FLAT = r"([^{}\[\]]*)"
#: A key without a value, which holds nothing that is wrapped.
_BARE_KEY = (r'\{"key":("[^"]*")\}', "$1:null")
#: One level of protocol wrapping, innermost first: what such text begins with, its form, and the plain value it stands for.
_UNWRAP = (
    ('{"arrayValue":', r'\{"arrayValue":\{(?:"values":\[' + _FLAT + r"\])?\}\}", f"{_DONE['[']}$1{_DONE[']']}"),
    ('{"value":', r'\{"value":' + _FLAT + r',"key":("[^"]*")\}', "$2:$1"),
    ('{"key":', r'\{"key":("[^"]*"),"value":' + _FLAT + r"\}", "$1:$2"),
    ('{"kvlistValue":', r'\{"kvlistValue":\{(?:"values":\[' + _FLAT + r"\])?\}\}", f"{_DONE['{']}$1{_DONE['}']}"),
)


#: Text that is of the protocol's form throughout and has no blanks: what begins a list or map stands for the sign it has in
#: plain text, _OPEN and the sign it ends with; what ends one, for _CLOSE. Braces left are the ends of map entries.
_OPEN, _CLOSE = "\x14", "\x15"
_MARKS = (('{"arrayValue":{"values":[', f"{_DONE['[']}{_OPEN}{_DONE[']']}"), ('{"kvlistValue":{"values":[', f"{_DONE['{']}{_OPEN}{_DONE['}']}"),
          ('{"arrayValue":{}}', f"{_DONE['[']}{_DONE[']']}"), ('{"kvlistValue":{}}', f"{_DONE['{']}{_DONE['}']}"))
#: Quotes are the ends of strings here, as escaped ones have a stand-in, so these need no shield.
_STRING = (r'\{"(?:stringValue|bytesValue)":("[^"]*")\}', "$1")
_ENTRY = (r'\{"key":("[^"]*"),"value":', "$1:")
_INNERMOST = (f"{_OPEN}(.)([^{_OPEN}{_CLOSE}]*){_CLOSE}", "$2$1")


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, though it is used several times."""
    return F.get(F.transform(F.array(value), then), 0)


def plain_json(wrapped: Column) -> Column:
    """A list or map of the protocol's JSON form as plain JSON text, however deep it is.

    Where the text is lists, maps and entries that begin with their key, as exports are written, all that begins one is
    marked at once, and one pass a level gives their ends the sign. Any other text is unwrapped rule by rule.
    Whatever is not of the protocol's form stays as it was sent.
    """
    def plain(coded: Column) -> Column:
        valid = F.get_json_object(F.concat(F.lit("["), wrapped, F.lit("]")), "$").isNotNull()
        closed = _with(_marked(coded), lambda m: F.when(_well_formed(m) & valid, _closed(m)))
        return _with(closed, lambda c: F.when(~(F.contains(c, F.lit(_OPEN)) | F.contains(c, F.lit(_CLOSE))), F.translate(c, "}", ""))
                     .otherwise(_with(_scalars(_shielded(coded)), _unwrapped)))

    coded = wrapped
    for sign, code in _ESCAPES:
        coded = F.replace(coded, F.lit(sign), F.lit(code))
    text = F.translate(_with(coded, plain), _HIDDEN + "".join(_DONE.values()), _PUNCTUATION + "".join(_DONE))
    for sign, code in _ESCAPES:
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _shielded(text: Column) -> Column:
    """Text without blanks around strings, and with stand-ins in them, so that what is left of punctuation is structure."""
    parts = F.transform(F.split(text, '"', -1), lambda part, i: F.when(i % 2 == 1, F.translate(part, _PUNCTUATION, _HIDDEN)).otherwise(
        F.translate(part, " \t\n\x0b\f\r", "")))
    return F.array_join(parts, '"')


def _scalars(text: Column) -> Column:
    """Shielded text whose scalars have lost their wrapping. A rule is tried only on text with something that begins like it."""
    rules = (('{"', r'\{"(?:stringValue|bytesValue|boolValue)":([^{}\[\],]*)\}', "$1"), ('{"', r'\{"(?:intValue|doubleValue)":"?([^"{}\[\],]*)"?\}', "$1"),
             ("{}", r'(?<="value":)\{\}|(?<=[\[,])\{\}(?=[,\]])', "null"), ('{"key":', *_BARE_KEY))
    def tried(begin: str, pattern: str, then: str) -> Callable[[Column], Column]:
        return lambda t: F.when(F.contains(t, F.lit(begin)), F.regexp_replace(t, pattern, then)).otherwise(t)

    for rule in rules:
        text = _with(text, tried(*rule))
    return text


def _marked(text: Column) -> Column:
    for begin, mark in _MARKS:
        text = F.replace(text, F.lit(begin), F.lit(mark))
    text = F.regexp_replace(F.regexp_replace(text, *_STRING), *_ENTRY)
    return F.replace(_scalars(_shielded(text)), F.lit("]}}"), F.lit(_CLOSE))


def _well_formed(marked: Column) -> Column:
    """Whether marks stand for all lists and maps and the keys of all entries, so that what is left of braces ends entries."""
    return ~(F.contains(marked, F.lit("{")) | F.contains(marked, F.lit("[")) | F.contains(marked, F.lit("]")))


def _levels(text: Column, begin: str, end: str) -> Column:
    """How deep what begins and ends with these signs is nested."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(f"[{begin}{end}]"), F.lit(0)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
                       lambda d, b: F.struct((d["now"] + F.when(b == begin.removeprefix("\\"), 1).otherwise(-1)).alias("now"),
                                             F.greatest(d["most"], d["now"] + 1).alias("most")), lambda d: d["most"])


def _closed(marked: Column) -> Column:
    """Marked text with the sign of each list at its end: innermost lists first, a level at a time."""
    return F.aggregate(F.sequence(F.lit(0), _levels(marked, _OPEN, _CLOSE)), marked, lambda t, _: F.when(
        F.contains(t, F.lit(_CLOSE)), F.regexp_replace(t, *_INNERMOST)).otherwise(t))


def _unwrapped(text: Column) -> Column:
    """Each pass unwraps the innermost level that is left; there are as many passes as the text has levels of lists.

    A rule is tried only while the text has something that begins like it.
    """
    last = (_levels(text, r"\[", r"\]") + 1) * len(_UNWRAP) - 1
    return F.aggregate(F.sequence(F.lit(0), last), text, lambda t, i: reduce(
        lambda chain, rule: chain.when((i % len(_UNWRAP) == rule[0]) & F.contains(t, F.lit(rule[1][0])), F.regexp_replace(t, *rule[1][1:])),
        enumerate(_UNWRAP), F.when(F.lit(False), t)).otherwise(t))


def any_text(v: Column) -> Column:
    """Scalars as plain text, lists and maps as JSON text, an empty value as NULL."""
    nested = [F.when(v[kind].isNotNull(), plain_json(F.concat(F.lit('{"' + kind + '":'), v[kind], F.lit("}")))) for kind in ("arrayValue", "kvlistValue")]
    return F.coalesce(*[v[kind] for kind in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue")], *nested)


def attribute_map(pairs: Column) -> Column:
    """Attributes as a map; of equal keys the last one counts."""
    entries = F.transform(F.filter(pairs, lambda p: p["key"].isNotNull()), lambda p: F.struct(p["key"], any_text(p["value"])))
    return F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string, string>"))


def nested_keys(pairs: Column) -> Column:
    nested = F.filter(pairs, lambda p: p["value"]["arrayValue"].isNotNull() | p["value"]["kvlistValue"].isNotNull())
    return F.coalesce(F.transform(nested, lambda p: p["key"]), F.array().cast("array<string>"))


def _nanos_time(nanos: Column) -> Column:
    """Nanoseconds to a timestamp by whole division; zero and absent are NULL."""
    value = number(nanos, "long")
    return F.when(value > 0, F.timestamp_micros(F.call_function("div", value, F.lit(1000))))


def _hex(text: Column) -> Column:
    return F.lower(blank_to_null(text))


def _labelled(code: Column, labels: dict[int, str], prefix: str) -> Column:
    """A protocol enum as number or as name."""
    chain = None
    for n, label in labels.items():
        test = code.isin(str(n), prefix + label.upper())
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def _exploded(df: DataFrame, schema: str, outer: str, scopes: str, items: str) -> DataFrame:
    # Repeated keys are legal in an export; without this Spark would fail the row.
    df.sparkSession.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    parsed = df.select(F.from_json("value", schema).alias("doc"), *[c for c in ("received_at",) if c in df.columns])
    resources = parsed.select("*", F.explode(f"doc.{outer}").alias("r")).drop("doc")
    scoped = resources.select("*", F.explode(f"r.{scopes}").alias("s"))
    out = scoped.select("*", F.explode(f"s.{items}").alias("x"))
    return out if "received_at" in out.columns else out.withColumn("received_at", F.current_timestamp())


def _common() -> list[Column]:
    return [F.col("s.scope.name").alias("scope_name"), attribute_map(F.col("r.resource.attributes")).alias("resource_attributes"),
            attribute_map(F.col("s.scope.attributes")).alias("scope_attributes"), F.col("received_at")]


def _identified(df: DataFrame, *columns: str) -> DataFrame:
    """A stable id from content and origin, so a replayed export gives the same ids and another host's rows do not."""
    origin = ("scope_name", "scope_attributes", "resource_attributes")
    parts = [F.to_json(F.array_sort(F.map_entries(c))) if c.endswith("attributes") else F.col(c).cast("string") for c in (*columns, *origin)]
    return df.withColumn("id", F.xxhash64(*[F.coalesce(p, F.lit("\0")) for p in parts])).select("id", *df.columns)


def flatten_otlp_logs(df: DataFrame) -> DataFrame:
    x = F.col("x")
    observed = _nanos_time(x["observedTimeUnixNano"])
    rows = _exploded(df, _LOGS, "resourceLogs", "scopeLogs", "logRecords").select(
        F.coalesce(_nanos_time(x["timeUnixNano"]), observed).alias("timestamp"), observed.alias("observed_timestamp"),
        F.nullif(number(x["severityNumber"], "int"), F.lit(0)).alias("severity_number"), blank_to_null(x["severityText"]).alias("severity_text"),
        any_text(x["body"]).alias("body"), _hex(x["traceId"]).alias("trace_id"), _hex(x["spanId"]).alias("span_id"),
        attribute_map(x["attributes"]).alias("attributes"), nested_keys(x["attributes"]).alias("nested_attribute_keys"), *_common())
    return _identified(rows, "timestamp", "trace_id", "span_id", "body", "attributes")


def flatten_otlp_metrics(df: DataFrame) -> DataFrame:
    """Number points of sums and gauges; other metric kinds are left out."""
    m = _exploded(df, _METRICS, "resourceMetrics", "scopeMetrics", "metrics")
    points = F.coalesce(F.col("x.sum.dataPoints"), F.col("x.gauge.dataPoints"))
    p = F.col("p")
    double, whole = number(p["asDouble"]), number(p["asInt"], "long")
    rows = m.select("*", F.explode(points).alias("p")).select(
        F.col("x.name").alias("metric_name"), F.coalesce("x.unit", F.lit("")).alias("unit"), F.coalesce("x.description", F.lit("")).alias("description"),
        _nanos_time(p["timeUnixNano"]).alias("timestamp"), _nanos_time(p["startTimeUnixNano"]).alias("start_timestamp"),
        double.alias("value_double"), F.when(double.isNull(), whole).alias("value_long"),
        F.when(double.isNotNull(), "double").when(whole.isNotNull(), "long").otherwise("unknown").alias("value_kind"),
        attribute_map(p["attributes"]).alias("attributes"), *_common())
    return _identified(rows, "metric_name", "timestamp", "start_timestamp", "value_double", "value_long", "attributes")


def flatten_otlp_spans(df: DataFrame) -> DataFrame:
    x = F.col("x")
    start, end = number(x["startTimeUnixNano"], "long"), number(x["endTimeUnixNano"], "long")
    events = F.transform(x["events"], lambda e: F.struct(e["name"].alias("name"), _nanos_time(e["timeUnixNano"]).alias("timestamp"),
                                                         attribute_map(e["attributes"]).alias("attributes")))
    rows = _exploded(df, _SPANS, "resourceSpans", "scopeSpans", "spans").select(
        _hex(x["traceId"]).alias("trace_id"), _hex(x["spanId"]).alias("span_id"), _hex(x["parentSpanId"]).alias("parent_span_id"),
        x["name"].alias("name"), _labelled(x["kind"], SPAN_KINDS, "SPAN_KIND_").alias("kind"),
        _nanos_time(x["startTimeUnixNano"]).alias("start_timestamp"), _nanos_time(x["endTimeUnixNano"]).alias("end_timestamp"),
        (end - start).alias("duration_nanos"), _labelled(x["status"]["code"], STATUS_CODES, "STATUS_CODE_").alias("status_code"),
        blank_to_null(x["status"]["message"]).alias("status_message"), attribute_map(x["attributes"]).alias("attributes"),
        F.when(F.size(x["events"]) > 0, events).alias("events"), *_common())
    return _identified(rows, "trace_id", "span_id", "start_timestamp")


_REQUESTS = {"logs": (_LOGS, "resourceLogs"), "points": (_METRICS, "resourceMetrics"), "spans": (_SPANS, "resourceSpans")}


def rejected_exports(df: DataFrame, table: str) -> DataFrame:
    """(value, reason) of the requests that are no such export as a whole; blank lines are none."""
    schema, outer = _REQUESTS[table]
    doc = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = df.where(F.trim("value") != "").select("value", doc.alias("doc"))
    unread = F.get_json_object("value", "$").isNull()
    reason = (F.when(unread, "not JSON").when(F.col("doc._corrupt_record").isNotNull(), "partly unreadable")
              .when(F.col(f"doc.{outer}").isNull(), f"no {outer}"))
    return parsed.select("value", reason.alias("reason")).where("reason IS NOT NULL")
