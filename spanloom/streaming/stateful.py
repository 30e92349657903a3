"""Per-key stream state: counter increments with late rows, and traces still running.

State is short: a counter keeps only the points younger than the lateness allowed and
one older one, a trace keeps two values. Python sees Arrow batches of one key's rows;
the partitioning and the state store are Spark's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.sources.deltas import current_value

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STALE_MINUTES = 20
#: Streams are dealt over this many keys of the state store: one read and one write serve all streams of a key in a batch.
BUCKETS = 4096
_NONE = -(2**63)  # stands for NULL, so that the other numbers of a batch stay whole
_POINT = "stream_id string, at long, id long, value double, open boolean"


class _DeltaState(StatefulProcessor):
    """Points of some streams: ``open`` ones are young enough to be corrected, the newest other one of each is its floor."""

    def __init__(self, lateness_us: int) -> None:
        self.lateness_us = lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", _POINT)

    def _placed(self, kept: list[tuple], floor: tuple | None, arrived: dict[int, tuple], stream, out: list[tuple]) -> tuple[list[tuple], tuple | None]:
        """Changes that new points of a stream bring go to ``out``; returns its points still open and its floor."""
        seen = {p[1] for p in kept}
        new = [p for i, p in arrived.items() if i not in seen]
        late = [p for p in new if floor is not None and p[:2] <= floor[:2]]
        fresh = {p[1] for p in new if floor is None or p[:2] > floor[:2]}
        line = sorted(kept + [p for p in new if p[1] in fresh])
        previous, changed = floor, False
        for point in line:
            before = 0.0 if previous is None else previous[2]
            if point[1] in fresh or changed:
                out.append((stream, point[1], point[0], point[2] - before if point[2] >= before else point[2], "insert" if point[1] in fresh else "update"))
            changed = point[1] in fresh
            previous = point
        # Too late for the kept points: the batch repair has to place these.
        out += [(stream, p[1], p[0], None, "repair") for p in late]
        horizon = line[-1][0] - self.lateness_us if line else 0
        old = [p for p in line if p[0] < horizon]
        return line[len(old):], old[-1] if old else floor

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, floors, arrived = defaultdict(list), {}, defaultdict(dict)
        for stream, at, i, value, is_open in self.points.get() if self.points.exists() else ():
            if is_open:
                kept[stream].append((at, i, value))
            else:
                floors[stream] = (at, i, value)
        for batch in rows:
            for stream, at, i, value in zip(*(batch[c].tolist() for c in ("stream_id", "at", "id", "value"))):
                arrived[stream][i] = (at, i, value)
        out = []
        for stream, points in arrived.items():
            kept[stream], floor = self._placed(sorted(kept[stream]), floors.get(stream), points, stream, out)
            if floor is not None:
                floors[stream] = floor
        self.points.put([(s, *p, True) for s, line in kept.items() for p in line] + [(s, *p, False) for s, p in floors.items()])
        out = [(s, None if i == _NONE else i, None if at == _NONE else at, delta, change) for s, i, at, delta, change in out]
        yield pd.DataFrame(out, columns=["stream_id", "id", "at", "value_delta", "change"], dtype=object)

    def close(self) -> None:
        pass


def stream_deltas(points: DataFrame, lateness_seconds: int = 3600) -> DataFrame:
    """Increments of a point stream, with updates of rows whose predecessor came late.

    ``change`` is ``insert``, ``update`` (replaces the earlier increment of that id), or
    ``repair`` for rows past the allowed lateness. A longer lateness keeps more state.
    """
    rows = points.select(F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS)).alias("bucket"), "stream_id", F.coalesce(F.unix_micros("timestamp"), F.lit(_NONE)).alias("at"),
                         F.coalesce("id", F.lit(_NONE)).alias("id"), current_value().alias("value"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_DeltaState(lateness_seconds * 1_000_000),
        outputStructType="stream_id string, id long, at long, value_delta double, change string",
        outputMode="Append", timeMode="None")


class _TraceState(StatefulProcessor):
    def __init__(self, stale_ms: int) -> None:
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, status string, timer long")

    def _emit(self, key, status: str, last: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], status, last)], columns=["trace_id", "status", "last_activity"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, status, timer = tuple(self.state.get()) if self.state.exists() else (0, "", 0)
        closed = status == "closed"
        for batch in rows:
            last = max(last, int(batch["at"].max()))
            closed = closed or bool(batch["is_root"].any())
        now = "closed" if closed else "running"
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0
        if not closed:
            timer = last // 1000 + self.stale_ms
            self.handle.registerTimer(timer)
        self.state.update((last, now, timer))
        if now != status:
            yield self._emit(key, now, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, _ = tuple(self.state.get())
        self.state.update((last, "stale", 0))
        yield self._emit(key, "stale", last)

    def close(self) -> None:
        pass


def stream_trace_status(spans: DataFrame, stale_minutes: int = STALE_MINUTES, delay: str = "1 minute") -> DataFrame:
    """Status changes of traces: running, closed once a root span ends, stale after silence."""
    rows = spans.withWatermark("end_timestamp", delay).select(
        "trace_id", "end_timestamp", F.unix_micros("end_timestamp").alias("at"), F.col("parent_span_id").isNull().alias("is_root"))
    return rows.groupBy("trace_id").transformWithStateInPandas(
        statefulProcessor=_TraceState(stale_minutes * 60_000), outputStructType="trace_id string, status string, last_activity long",
        outputMode="Append", timeMode="EventTime")
