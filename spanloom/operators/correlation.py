"""Finding the span a log belongs to."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig
from spanloom.functions import expr as E
from spanloom.functions.skew import carry_last, cut_lineage, previous_row, row_numbers, running_total, time_chunk
from spanloom.operators.span_tree import span_paths

TOLERANCE_MS = 1000
#: Rows of one unbroken stretch of a time line that a task matches at once; longer ones are thinned out by rounds first.
STRETCH = 100_000
#: Rows of a longer stretch that a task looks at together in the first round; twice as many in each further one, up to ``STRETCH``.
BLOCK = 4096
_KEYS = ["prompt_id", "model"]
_ORDER = ["at", "turn", "side", "id"]
_PAIRS = "prompt_id string, model string, body_id long, request_log_id long, request_id string, offset_ms long"
_PAIRS_ARROW = pa.schema({"prompt_id": pa.string(), "model": pa.string(), "body_id": pa.int64(), "request_log_id": pa.int64(),
                          "request_id": pa.string(), "offset_ms": pa.int64()})


def _time_line(logs: DataFrame, cfg: TelemetryConfig) -> DataFrame:
    """Bodies (side 0) and requests (side 1, when they were issued) of each prompt and model; those of one instant take turns."""
    common = F.col("prompt_id").isNotNull() & (F.col("prompt_id") != "") & F.col("model").isNotNull() & (F.col("model") != "")
    bodies = logs.where((F.col("event_name") == cfg.api_request_body) & common).select(
        *_KEYS, F.unix_micros("timestamp").alias("at"), F.lit(0).alias("side"), "id", F.lit(None).cast("string").alias("request_id"))
    requests = logs.where((F.col("event_name") == cfg.api_request) & common & F.col("request_id").isNotNull() & F.col("duration_ms").isNotNull()).select(
        *_KEYS, (F.unix_micros("timestamp") - (F.floor("duration_ms") * 1000).cast("long")).alias("at"), F.lit(1).alias("side"), "id", "request_id")
    turn = F.row_number().over(Window.partitionBy(*_KEYS, "at", "side").orderBy("id"))
    return bodies.unionByName(requests).withColumn("turn", turn).select(*_KEYS, *_ORDER, "request_id")


def _stretches(line: DataFrame, tolerance_ms: int) -> DataFrame:
    """The line with ``stretch`` (cut where two neighbours are too far apart for any pair across) and its ``size``.

    Stretches with rows of one side only hold no pair and are left out.
    """
    chunk = time_chunk(F.timestamp_micros("at"))
    seen = previous_row(line, _KEYS, _ORDER, F.col("at"), "before", chunk=chunk)
    far = F.when(F.floor((F.col("at") - F.col("before")) / 1000) > tolerance_ms, 1).otherwise(0)
    cut = cut_lineage(running_total(seen, _KEYS, _ORDER, far, "stretch", chunk=chunk).drop("before"))
    sizes = cut.groupBy(*_KEYS, "stretch").agg(F.count(F.lit(1)).alias("size"), F.min("side").alias("low"), F.max("side").alias("high"))
    return cut.join(sizes.where("low < high").drop("low", "high"), [*_KEYS, "stretch"])


def closest_pairs(at: Sequence[int], side: Sequence[int], tolerance_ms: int, before_it: bool = False, after_it: bool = False) -> list[tuple[int, int]]:
    """Index pairs of neighbours on a line (sorted), of different sides: the closest first, of equals the earlier.

    A pair that is taken leaves the line, and its neighbours become each other's. Where the line goes on unseen before or
    after these rows, only pairs are given that no unseen row can change.
    """
    before, after = list(range(-1, len(at) - 1)), [*range(1, len(at)), -1]
    open_ = [True] * len(at)
    heap: list[tuple[int, int, int]] = []
    # Rows that an unseen one, or one of these, may have taken by now: from both ends, with the innermost of each side.
    unsure = [False] * len(at)
    first, last = (0 if before_it else -1), (len(at) - 1 if after_it else -1)
    inner_left, inner_right = list(at[:1]) * 2, list(at[-1:]) * 2

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and side[i] != side[j] and (at[j] - at[i]) // 1000 <= tolerance_ms:
            heappush(heap, (at[j] - at[i], i, j))

    for i in range(len(at) - 1):
        offer(i, i + 1)
    found = []
    while heap:
        gap, i, j = heappop(heap)
        if not (open_[i] and open_[j] and after[i] == j):
            continue
        # A pair with an earlier row counts before one that is as close, a pair with a later row does not.
        while first >= 0 and (not open_[first] or at[first] - inner_left[1 - side[first]] <= gap):
            if open_[first]:
                unsure[first], inner_left[side[first]] = True, at[first]
            first = after[first]
        while last >= 0 and (not open_[last] or inner_right[1 - side[last]] - at[last] < gap):
            if open_[last]:
                unsure[last], inner_right[side[last]] = True, at[last]
            last = before[last]
        if unsure[i] or unsure[j]:
            continue
        found.append((i, j))
        open_[i] = open_[j] = False
        left, right = before[i], after[j]
        if left >= 0:
            after[left] = right
        if right >= 0:
            before[right] = left
        offer(left, right)
    return found


def _matched(stretches: DataFrame, tolerance_ms: int, block: Column, number: Column, size: Column) -> DataFrame:
    """Pairs inside each block of a stretch, whose rows bear numbers of 1 to ``size``. A task holds one block at a time."""
    part = [*_KEYS, "stretch", "block"]
    rows = stretches.select(*_KEYS, "stretch", *_ORDER, "request_id", block.alias("block"), number.alias("number"), size.alias("size"))
    # The number of partitions is given, as a task's work is in its rows, not in their few bytes.
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *part).sortWithinPartitions(*part, *_ORDER)

    def pairs_of(held: list[dict]) -> Iterator[dict]:
        found = closest_pairs([r["at"] for r in held], [r["side"] for r in held], tolerance_ms, held[0]["number"] > 1, held[-1]["number"] < held[-1]["size"])
        for first, second in ((held[i], held[j]) for i, j in found):
            body, request = (first, second) if first["side"] == 0 else (second, first)
            yield {"prompt_id": body["prompt_id"], "model": body["model"], "body_id": body["id"], "request_log_id": request["id"],
                   "request_id": request["request_id"], "offset_ms": (second["at"] - first["at"]) // 1000}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                here = [row[c] for c in part]
                if held and here != of:
                    out += pairs_of(held)
                    held = []
                held.append(row)
                of = here
            yield pa.RecordBatch.from_pylist(out, _PAIRS_ARROW)
        if held:
            yield pa.RecordBatch.from_pylist(list(pairs_of(held)), _PAIRS_ARROW)

    return dealt.mapInArrow(match, _PAIRS)


def _matched_at_once(stretches: DataFrame, tolerance_ms: int) -> DataFrame:
    return _matched(stretches, tolerance_ms, F.lit(0), F.lit(1), F.lit(1))


def _matched_in_blocks(stretches: DataFrame, tolerance_ms: int, block: int, shift: int) -> DataFrame:
    """The pairs of long stretches that are certain from the rows of one block each."""
    numbered = row_numbers(stretches, [*_KEYS, "stretch"], _ORDER, "number", chunk=time_chunk(F.timestamp_micros("at")))
    return _matched(numbered, tolerance_ms, F.floor((F.col("number") + shift) / block), F.col("number"), F.col("size"))


def _nearest_other(df: DataFrame, forward: bool) -> DataFrame:
    """The nearest row of the other side before or after each row, as ``other_before`` or ``other_after``."""
    sign = -1 if forward else 1
    signed = df.withColumns({f"__{c}": sign * F.col(c) for c in _ORDER})
    chunk = sign * time_chunk(F.timestamp_micros("at"))
    order = [f"__{c}" for c in _ORDER]
    for side in (0, 1):
        signed = carry_last(signed, _KEYS, order, F.when(F.col("side") == side, F.struct("at", "id", "request_id")), f"__s{side}", include_current=False, chunk=chunk)
    found = F.when(F.col("side") == 0, F.col("__s1")).otherwise(F.col("__s0"))
    return signed.withColumn("other_after" if forward else "other_before", found).drop(*order, "__s0", "__s1")


def _mutual(line: DataFrame, tolerance_ms: int) -> DataFrame:
    """Pairs of rows that are each other's nearest: whatever else is taken first, these are pairs in the end."""
    seen = _nearest_other(_nearest_other(line, False), True)
    back, ahead = F.col("at") - F.col("other_before.at"), F.col("other_after.at") - F.col("at")
    far = F.lit(2**62)
    looks_back = F.coalesce(back, far) <= F.coalesce(ahead, far)
    ways = [*_KEYS, "side", "id", "request_id"]
    later = seen.where(looks_back & (F.floor(back / 1000) <= tolerance_ms)).select(*ways, F.col("other_before").alias("other"), F.floor(back / 1000).cast("long").alias("offset_ms"))
    sooner = seen.where(~looks_back).select(*[F.col(k).alias(f"o_{k}") for k in _KEYS], F.col("side").alias("o_side"), F.col("id").alias("o_id"),
                                            F.col("other_after.id").alias("o_wants"))
    met = later.join(sooner, (F.col("o_id") == F.col("other.id")) & (F.col("o_wants") == F.col("id")) & (F.col("o_side") != F.col("side"))
                     & reduce(lambda a, b: a & b, [F.col(k) == F.col(f"o_{k}") for k in _KEYS]), "inner")
    body = F.col("side") == 0
    return met.select(*_KEYS, F.when(body, F.col("id")).otherwise(F.col("other.id")).alias("body_id"), F.when(body, F.col("other.id")).otherwise(F.col("id")).alias("request_log_id"),
                      F.when(body, F.col("other.request_id")).otherwise(F.col("request_id")).alias("request_id"), "offset_ms")


def pair_bodies_to_requests(logs: DataFrame, tolerance_ms: int = TOLERANCE_MS, cfg: TelemetryConfig = CFG, stretch: int = STRETCH) -> DataFrame:
    """Match each request body with one request of its prompt and model, closest pairs first.

    A request counts from when it was issued. Time lines fall into stretches where neighbours are farther apart than
    the tolerance; each is matched by itself. A stretch too long for one task is looked at block by block and loses the
    pairs that are certain there, round by round, until all that is left of it is short; where blocks are sure of none,
    it loses those that are each other's nearest. Of equally close pairs the earlier one counts.
    """
    line, matched, block, shifted = cut_lineage(_time_line(logs, cfg)), [], BLOCK, False
    while True:
        cut = cut_lineage(_stretches(line, tolerance_ms))
        matched.append(_matched_at_once(cut.where(F.col("size") <= stretch), tolerance_ms))
        long = cut.where(F.col("size") > stretch)
        if long.isEmpty():
            return reduce(DataFrame.unionByName, matched)
        pairs = cut_lineage(_matched_in_blocks(long, tolerance_ms, block, block // 2 if shifted else 0))
        if pairs.isEmpty():
            pairs = cut_lineage(_mutual(long.select(*line.columns), tolerance_ms))
        matched.append(pairs)
        used = pairs.select(F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("body_id").alias("id")),
                                             F.struct(F.lit(1).alias("side"), F.col("request_log_id").alias("id")))))
        line = long.join(used, ["side", "id"], "left_anti").select(*line.columns)
        block, shifted = min(2 * block, max(STRETCH, BLOCK)), not shifted


def _spans_by(spans: DataFrame, name: str, key: str) -> DataFrame:
    rows = spans.where((F.col("name") == name) & (F.col(key) != ""))
    return rows.groupBy("trace_id", key).agg(F.min_by("span_id", F.struct("start_timestamp", "span_id")).alias("found"))


def resolve_leaf_span(logs: DataFrame, spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """Move a log to the deepest span that is its own: by tool call, by request, by paired body.

    It moves only down: its present span must be an ancestor of the new one, or absent.
    """
    base = logs.where("trace_id IS NOT NULL").select("id", "trace_id", "span_id", "tool_use_id", "request_id")
    paired = pair_bodies_to_requests(logs, cfg=cfg).select(F.col("body_id").alias("id"), F.col("request_id").alias("paired_request"))
    by_tool = _spans_by(spans, cfg.tool_execution_span, "tool_use_id").withColumnRenamed("found", "by_tool")
    by_request = _spans_by(spans, cfg.llm_span, "request_id")
    out = base.join(by_tool, ["trace_id", "tool_use_id"], "left").join(by_request.withColumnRenamed("found", "by_request"), ["trace_id", "request_id"], "left")
    out = out.join(paired, "id", "left").join(
        by_request.withColumnsRenamed({"request_id": "paired_request", "found": "by_body"}), ["trace_id", "paired_request"], "left")
    out = out.withColumn("target", F.coalesce("by_tool", "by_request", "by_body"))
    # The parent of a root counts as above it: in an unfinished trace it is not stored yet.
    paths = span_paths(spans, {"parent": F.col("parent_span_id")}).select(
        "trace_id", F.col("span_id").alias("target"), F.transform("path", lambda e: e["parent"]).alias("above"))
    out = out.join(paths, ["trace_id", "target"], "left")
    moves = F.col("target").isNotNull() & (F.col("span_id").isNull() | F.array_contains("above", F.col("span_id")))
    return out.select("id", "trace_id", F.col("span_id").alias("logged_span_id"),
                      F.when(F.coalesce(moves, F.lit(False)), F.col("target")).otherwise(F.col("span_id")).alias("span_id"))


def bucket_logs_by_span(logs: DataFrame, spans: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """The span each log is shown under, with the keys that order logs inside a span.

    A log stays where it is inside its own tool call; else it goes to the tool call's
    span, else to its own span, else to the trace's first root.
    """
    paths = span_paths(spans, keep=("name", "tool_use_id"))
    ids = F.transform("path", lambda e: e["span_id"])
    wrappers = (paths.where((F.col("name") == cfg.tool_span) & (F.col("tool_use_id") != "")).groupBy("trace_id", "tool_use_id")
                .agg(F.max_by("span_id", "path").alias("wrapper")))
    own = paths.select("trace_id", "span_id", ids.alias("ancestry"))
    roots = paths.where("depth = 0").groupBy("trace_id").agg(F.min_by("span_id", "path").alias("root"))
    a = F.col("attributes")
    rows = logs.select("id", "trace_id", "span_id", "tool_use_id", E.number(a["event.sequence"]).alias("event_sequence"),
                       F.coalesce(F.try_to_timestamp(a["event.timestamp"]), F.col("timestamp")).alias("event_time"))
    out = (rows.join(roots, "trace_id").join(own, ["trace_id", "span_id"], "left").join(wrappers, ["trace_id", "tool_use_id"], "left"))
    inside = F.coalesce(F.array_contains("ancestry", F.col("wrapper")), F.lit(False))
    known = F.when(F.col("ancestry").isNotNull(), F.col("span_id"))
    return out.select("id", "trace_id", F.when(inside, F.col("span_id")).otherwise(F.coalesce("wrapper", known, "root")).alias("shown_under"),
                      "event_sequence", "event_time")
