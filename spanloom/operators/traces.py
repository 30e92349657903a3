"""Traces: summaries, sorted and paged lists, histogram, facets, activity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange, ts_lit
from spanloom.functions import expr as E
from spanloom.functions.skew import cut_lineage, exact_percentiles
from spanloom.functions.timebins import bin_axis, bin_ts
from spanloom.operators.sessions import active_traces
from spanloom.sources.summaries import Summaries

FACET_LIMIT, SESSION_FACET_LIMIT = 50, 8

# List orders: (columns, descending). The last column breaks ties in the sort's own direction.
SORTS: dict[str, tuple[tuple[str, ...], bool]] = {
    "new": (("min_start", "trace_id"), True), "old": (("min_start", "trace_id"), False),
    "slow": (("duration_ms", "trace_id"), True), "fast": (("duration_ms", "trace_id"), False),
    "spans": (("span_count", "trace_id"), True), "err": (("error_count", "min_start", "trace_id"), True),
    "tokens": (("total_tokens", "trace_id"), True), "cost": (("total_cost_usd", "trace_id"), True),
}


@dataclass(frozen=True)
class TraceFilter:
    w: TimeRange = TimeRange()
    statuses: Sequence[str] = ()
    operations: Sequence[str] = ()
    services: Sequence[str] = ()
    durations: Sequence[str] = ()
    sessions: Sequence[str] = ()
    text: str = ""
    repository: str | None = None

    def facets(self) -> dict[str, tuple[str, Sequence[str]]]:
        return {"status": ("status", self.statuses), "operation": ("root_span_name", self.operations),
                "service": ("service", self.services), "duration_bucket": ("duration_bucket", self.durations),
                "session": ("session_id", self.sessions)}

    def matches_text(self) -> Column:
        if not self.text:
            return F.lit(True)
        test = F.lit(False)
        for c in ("trace_id", "session_id", "root_span_name"):
            test = test | F.col(c).ilike(f"%{self.text}%")
        return test

    def test(self, ignoring: str | None = None) -> Column:
        test = self.matches_text()
        for kind, (column, wanted) in self.facets().items():
            if wanted and kind != ignoring:
                test = test & F.col(column).isin(*wanted)
        return test


def trace_summaries(spans: DataFrame, logs: DataFrame | None, w: TimeRange = TimeRange(), repo: str | None = None,
                    kept: Summaries | None = None) -> DataFrame:
    """One row per trace with a span in the range.

    Sums cover the spans in the range. Root and cost are of the trace's whole life: they come from the summaries, where
    only the rows of these traces are grouped. Without ``logs`` there is no cost.
    """
    kept = kept or Summaries.of(spans=spans, logs=logs)
    inside = w.scan("start_timestamp") & E.in_repository(repo)
    sums = spans.where(inside).groupBy("trace_id").agg(
        F.min("start_timestamp").alias("min_start"), F.max("end_timestamp").alias("max_end"), E.row_count().alias("span_count"),
        F.count_if(F.col("status_code") == "error").alias("error_count"),
        F.coalesce(F.sum("total_tokens"), F.lit(0.0)).cast("long").alias("total_tokens"))
    wanted = sums.select("trace_id")
    roots = (kept.traces.join(wanted, "trace_id", "left_semi").groupBy("trace_id").agg(F.min("root").alias("r"))
             .select("trace_id", F.col("r.span_id").alias("root_span_id"), F.coalesce("r.name", F.lit("")).alias("root_span_name"),
                     F.coalesce("r.session_id", F.lit("")).alias("session_id")))
    out = sums.join(roots, "trace_id", "left")
    if logs is not None:
        costs = kept.trace_logs.join(wanted, "trace_id", "left_semi").groupBy("trace_id").agg(F.sum("cost_usd").alias("total_cost_usd"))
        out = out.join(costs, "trace_id", "left")
        out = out.withColumn("total_cost_usd", F.coalesce("total_cost_usd", F.lit(0).cast(E.MONEY)))
    ms = (F.unix_micros("max_end") - F.unix_micros("min_start")) / 1000.0
    return (out.withColumn("duration_ms", ms).withColumn("status", F.when(F.col("error_count") > 0, "error").otherwise("ok"))
            .withColumn("service", E.trace_service("root_span_name")).withColumn("duration_bucket", E.duration_bucket("duration_ms")))


def _filtered(spans: DataFrame, logs: DataFrame | None, f: TraceFilter, kept: Summaries | None) -> DataFrame:
    return trace_summaries(spans, logs, f.w, f.repository, kept).where(f.test())


def _past(columns: Sequence[str], descending: bool, values: Sequence, after_cursor: bool) -> Column:
    """Rows later in the list than the cursor (or earlier), compared column by column."""
    smaller = descending == after_cursor
    test = None
    for column, value in reversed(list(zip(columns, values))):
        value = ts_lit(value) if isinstance(value, datetime) else F.lit(value)
        c = F.col(column)
        beyond = c < value if smaller else c > value
        test = beyond if test is None else beyond | ((c == value) & test)
    return test


def trace_list(spans: DataFrame, logs: DataFrame, sort: str = "new", mode: str = "first", f: TraceFilter = TraceFilter(),
               cursor: Sequence | None = None, page: int = 0, size: int = 50, kept: Summaries | None = None) -> DataFrame:
    """A page of the list. ``before`` continues past the cursor, ``after`` returns what came in ahead of it.

    ``cursor`` holds the sort keys of a row, as ``trace_cursor_key`` returns them; without
    one (its trace is gone) the first page is returned. Cursor pages hold one row more.
    """
    columns, descending = SORTS[sort]
    order = [F.desc(c) if descending else F.asc(c) for c in columns]
    rows = _filtered(spans, logs, f, kept)
    if mode == "offset":
        return rows.orderBy(*order).offset(page * size).limit(size)
    if mode == "first" or cursor is None:
        return rows.orderBy(*order).limit(size + 1)
    rows = rows.where(_past(columns, descending, cursor, mode == "before"))
    if mode == "after" and sort == "old":
        # Of the rows ahead of the cursor, the ones next to it.
        return rows.orderBy(*[F.desc(c) for c in columns]).limit(size + 1).orderBy(*order)
    return rows.orderBy(*order).limit(size + 1)


def trace_cursor_key(spans: DataFrame, logs: DataFrame, sort: str, trace_id: str, f: TraceFilter = TraceFilter()) -> tuple | None:
    """The cursor row's sort keys, or None when the trace no longer exists."""
    one = trace_summaries(spans.where(F.col("trace_id") == trace_id), logs.where(F.col("trace_id") == trace_id), f.w, f.repository)
    row = one.select(*[F.unix_micros(c).alias(c) if c == "min_start" else F.col(c) for c in SORTS[sort][0]]).first()
    if row is None:
        return None
    return tuple(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=v) if n == "min_start" else v
                 for n, v in row.asDict().items())


def trace_count(spans: DataFrame, f: TraceFilter, kept: Summaries | None = None) -> DataFrame:
    return _filtered(spans, None, f, kept).agg(E.row_count().alias("row_count"))


def trace_histogram(spans: DataFrame, f: TraceFilter, bucket_seconds: int, kept: Summaries | None = None) -> DataFrame:
    # Read for its bins and again for their percentiles.
    rows = cut_lineage(_filtered(spans, None, f, kept).select("min_start", "status", "duration_ms"))
    rows = rows.withColumn("bucket", bin_ts("min_start", f.w.start, bucket_seconds))
    counts = rows.groupBy("bucket").agg(F.count_if(F.col("status") == "ok").alias("ok_count"),
                                        F.count_if(F.col("status") == "error").alias("error_count"))
    p95 = exact_percentiles(rows, ["bucket"], F.col("duration_ms"), {"p95_ms": 0.95})
    return (bin_axis(spans.sparkSession, f.w, bucket_seconds).join(counts, "bucket", "left").join(p95, "bucket", "left")
            .na.fill(0).orderBy("bucket"))


def trace_globals(spans: DataFrame, f: TraceFilter, kept: Summaries | None = None) -> DataFrame:
    # A row per trace, read for its counts and for the percentiles.
    rows = cut_lineage(_filtered(spans, None, f, kept).select("status", "duration_ms"))
    marks = exact_percentiles(rows, [], F.col("duration_ms"), {"p50_ms": 0.5, "p95_ms": 0.95})
    counts = rows.agg(E.row_count().alias("total"), F.count_if(F.col("status") == "error").alias("error_count"))
    return counts.withColumns({name: F.coalesce(marks.select(name).scalar(), F.lit(0.0)) for name in ("p50_ms", "p95_ms")})


def trace_facets(spans: DataFrame, f: TraceFilter, limit: int | None = FACET_LIMIT, session_limit: int | None = SESSION_FACET_LIMIT,
                 kept: Summaries | None = None) -> DataFrame:
    """Five facets in one pass, each blind to its own filter; the largest values of each, or all where a limit is None."""
    rows = trace_summaries(spans, None, f.w, f.repository, kept).where(f.matches_text())
    kinds = F.array(*[F.when(f.test(kind) & (F.col(column) != ""), F.struct(F.lit(kind).alias("facet_kind"), F.col(column).alias("facet_key")))
                      for kind, (column, _) in f.facets().items()])
    counts = (rows.select(F.explode(kinds).alias("k")).where("k IS NOT NULL").groupBy("k.facet_kind", "k.facet_key")
              .agg(E.row_count().alias("row_count")))
    if limit is None and session_limit is None:
        return counts
    limit, session_limit = ((1 << 31) - 1 if x is None else x for x in (limit, session_limit))
    # Spark keeps only the first rows of each kind before the shuffle of this rank.
    rank = F.row_number().over(Window.partitionBy("facet_kind").orderBy(F.desc("row_count"), "facet_key"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= max(limit, session_limit))
    kept = F.when(F.col("facet_kind") == "session", F.col("rank") <= session_limit).otherwise(F.col("rank") <= limit)
    return top.where(kept).drop("rank")


def trace_summary(spans: DataFrame, logs: DataFrame, trace_id: str) -> DataFrame:
    return trace_summaries(spans.where(F.col("trace_id") == trace_id), logs.where(F.col("trace_id") == trace_id))


def first_prompt_by_trace(logs: DataFrame, length: int | None = None, traces: DataFrame | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = logs.where((F.col("event_name") == cfg.user_prompt) & E.blank_to_null("prompt").isNotNull() & F.col("trace_id").isNotNull())
    if traces is not None:
        rows = rows.join(traces.select("trace_id").distinct(), "trace_id", "left_semi")
    return rows.groupBy("trace_id").agg(F.min_by(E.clean_prompt("prompt", length), F.struct("timestamp", "id")).alias("first_user_prompt"))


def in_progress_traces(spans: DataFrame, logs: DataFrame, since: datetime, traces: DataFrame | None = None,
                       kept: Summaries | None = None) -> DataFrame:
    """Traces without a root span that were active since."""
    kept = kept or Summaries.of(spans=spans, logs=logs)
    days = kept.traces if traces is None else kept.traces.join(traces.select("trace_id").distinct(), "trace_id", "left_semi")
    open_ = days.groupBy("trace_id").agg(F.max("has_root").alias("closed")).where("NOT closed").select("trace_id")
    return active_traces(kept, logs, since, open_)


def trace_latest_end(spans: DataFrame, trace_id: str | None = None) -> DataFrame:
    rows = spans if trace_id is None else spans.where(F.col("trace_id") == trace_id)
    return rows.groupBy("trace_id").agg(F.max("end_timestamp").alias("latest_end"))
