"""Log exploration: filters, histogram, facets, pages, attribute discovery, look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange, ts_lit
from spanloom.functions import expr as E
from spanloom.functions.skew import first_rows
from spanloom.functions.timebins import bin_axis, bin_ts

SEVERITIES = ("ERROR", "WARN", "INFO", "DEBUG")
FACET_LIMIT = 50
#: Rows of a page at most; None for as many as are asked for.
MAX_PAGE: int | None = None


@dataclass(frozen=True)
class LogFilter:
    w: TimeRange = TimeRange()
    severities: Sequence[str] = ()
    events: Sequence[str] = ()
    tools: Sequence[str] = ()
    pairs: Sequence[str] = ()
    text: str = ""
    repository: str | None = None

    def test(self, *ignoring: str) -> Column:
        test = self.w.scan() & E.in_repository(self.repository)
        for name, column, wanted in (("severity", "derived_severity", self.severities),
                                     ("event", "event_name", self.events), ("tool", "tool_name", self.tools)):
            if wanted and name not in ignoring:
                test = test & F.col(column).isin(*wanted)
        if self.text:
            test = test & E.full_text("body", "attributes", self.text)
        if self.pairs:
            test = test & E.attrs_match("attributes", self.pairs)
        return test


def log_histogram(logs: DataFrame, f: LogFilter, bucket_seconds: int) -> DataFrame:
    counts = (logs.where(f.test("severity"))
              .groupBy(bin_ts("timestamp", f.w.start, bucket_seconds).alias("bucket"))
              .agg(*[F.count_if(F.col("derived_severity") == s).alias(f"{s.lower()}_count") for s in SEVERITIES]))
    return bin_axis(logs.sparkSession, f.w, bucket_seconds).join(counts, "bucket", "left").na.fill(0).orderBy("bucket")


def log_facet_severity(logs: DataFrame, f: LogFilter) -> DataFrame:
    counts = logs.where(f.test("severity")).groupBy("derived_severity").agg(F.count(F.lit(1)).alias("row_count"))
    labels = logs.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "derived_severity string")
    return labels.join(counts, "derived_severity", "left").na.fill(0)


def _facet(logs: DataFrame, column: str, test: Column, limit: int | None) -> DataFrame:
    counts = (logs.where(test & (F.col(column) != "")).groupBy(F.col(column).alias("facet_value"))
              .agg(F.count(F.lit(1)).alias("row_count")))
    return first_rows(counts.orderBy(F.desc("row_count"), "facet_value"), limit)


def log_facet_event(logs: DataFrame, f: LogFilter, limit: int | None = FACET_LIMIT) -> DataFrame:
    return _facet(logs, "event_name", f.test("event"), limit)


def log_facet_tool(logs: DataFrame, f: LogFilter, limit: int | None = FACET_LIMIT) -> DataFrame:
    return _facet(logs, "tool_name", f.test("tool"), limit)


def log_count(logs: DataFrame, f: LogFilter) -> DataFrame:
    return logs.where(f.test()).agg(F.count(F.lit(1)).alias("row_count"))


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("id"))


def log_page_first(logs: DataFrame, f: LogFilter, size: int) -> DataFrame:
    """One row more than the page, so the caller can tell whether another page exists."""
    return _newest_first(logs.where(f.test())).limit(size + 1)


def _beside(when: datetime, row_id: int, before: bool) -> Column:
    at, ts = ts_lit(when), F.col("timestamp")
    # The plain bound on the timestamp is implied; stated, it reaches the scan.
    if before:
        return (ts <= at) & ((ts < at) | (F.col("id") < row_id))
    return (ts >= at) & ((ts > at) | (F.col("id") > row_id))


def log_page_before(logs: DataFrame, f: LogFilter, cursor: tuple[datetime, int], size: int) -> DataFrame:
    return _newest_first(logs.where(f.test() & _beside(*cursor, before=True))).limit(size + 1)


def log_page_after(logs: DataFrame, f: LogFilter, cursor: tuple[datetime, int], size: int) -> DataFrame:
    """The newest rows past the cursor, not the ones next to it."""
    return _newest_first(logs.where(f.test() & _beside(*cursor, before=False))).limit(size + 1)


def log_page_offset(logs: DataFrame, f: LogFilter, page: int, size: int) -> DataFrame:
    size = size if MAX_PAGE is None else min(size, MAX_PAGE)
    return _newest_first(logs.where(f.test())).offset(page * size).limit(size)


def _scalar_entries(logs: DataFrame, f: LogFilter) -> DataFrame:
    return (logs.where(f.test()).select(F.explode("attributes").alias("key", "value"), "nested_attribute_keys")
            .where(~F.array_contains("nested_attribute_keys", F.col("key"))))


def attribute_pairs(logs: DataFrame, f: LogFilter) -> DataFrame:
    pairs = _scalar_entries(logs, f).select(F.concat("key", F.lit("="), "value").alias("pair"))
    return pairs.where("pair IS NOT NULL").distinct().orderBy("pair")


def attribute_keys(logs: DataFrame, f: LogFilter) -> DataFrame:
    return _scalar_entries(logs, f).where("key <> 'body'").select("key").distinct().orderBy("key")


def attribute_values(logs: DataFrame, f: LogFilter, key: str) -> DataFrame:
    present = F.map_contains_key("attributes", F.lit(key)) & ~F.array_contains("nested_attribute_keys", F.lit(key))
    return (logs.where(f.test() & present).select(F.col("attributes")[key].alias("value")).distinct().orderBy("value"))


def last_response_before(logs: DataFrame, session: str, before: datetime, not_trace: str,
                         cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.assistant_response) & (F.col("session_id") == session)
                      & (F.col("timestamp") < ts_lit(before))
                      & (F.col("trace_id").isNull() | (F.col("trace_id") != not_trace)))
    return _newest_first(rows).limit(1)


def tool_call_by_id(logs: DataFrame, session: str, before: datetime, tool_use_id: str,
                    cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.tool_result) & (F.col("session_id") == session)
                      & (F.col("timestamp") < ts_lit(before)) & (F.col("tool_use_id") == tool_use_id))
    return _newest_first(rows).limit(1)


def dispatching_traces(logs: DataFrame, asked: DataFrame | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Newest trace of each (session, tool call). ``asked`` holds session_id, tool_use_id, before_ts."""
    calls = logs.where((F.col("event_name") == cfg.tool_result) & F.col("tool_use_id").isNotNull())
    calls = calls.select("session_id", "tool_use_id", "trace_id", "timestamp", "id")
    if asked is not None:
        calls = calls.join(asked, ["session_id", "tool_use_id"]).where(F.col("timestamp") < F.col("before_ts"))
    return calls.groupBy("session_id", "tool_use_id").agg(F.max_by("trace_id", F.struct("timestamp", "id")).alias("trace_id"))


def logs_for_trace(logs: DataFrame, trace_id: str) -> DataFrame:
    return logs.where(F.col("trace_id") == trace_id).orderBy("timestamp", "id")


def spans_for_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_timestamp", "span_id")
