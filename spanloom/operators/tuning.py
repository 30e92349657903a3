"""Findings that point at something to change: commands, sizes, repeats, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import TimeRange
from spanloom.functions import expr as E
from spanloom.functions.skew import first_rows, previous_row
from spanloom.operators.tools import (duration_and_output, failed, mcp_server_rollup, mcp_usage, sized_results, tool_results, tunable,
                                      tunable_context_footprint)

TOP = 10
NEAR_MISS_DISTANCE = 3
SLOW_MS, LARGE_BYTES = 1000, 4000

# Shell commands for which the agent has a tool of its own.
SHELL_REPLACEMENTS = {
    "cat": "Read", "head": "Read (with limit)", "tail": "Read (with offset)", "find": "Glob",
    "sed": "Read + Edit", "awk": "Grep", "echo": "Write",
}


def _bash(logs: DataFrame, w: TimeRange) -> DataFrame:
    return tool_results(logs, w).where(F.col("tool_name") == "Bash")


def first_token(text: Column) -> Column:
    return F.coalesce(E.blank_to_null(F.split_part(text, F.lit(" "), F.lit(1))), F.lit("unknown"))


def bash_hotspots(logs: DataFrame, w: TimeRange, limit: int | None = TOP) -> DataFrame:
    rows = _bash(logs, w).select(first_token(E.strip_cd("command")).alias("command_prefix"), "duration_ms", "result_bytes")
    return first_rows(duration_and_output(rows, ["command_prefix"]).orderBy(F.desc("calls"), "command_prefix"), limit)


def bash_coverage(logs: DataFrame, w: TimeRange) -> DataFrame:
    return _bash(logs, w).agg(
        F.count("command").alias("with_command"), E.row_count().alias("total"),
        F.count_if(F.col("command").rlike(r"^\s*cd\s")).alias("cd_prefixed"))


def oversized_results(logs: DataFrame, w: TimeRange, limit: int | None = TOP) -> DataFrame:
    rows = sized_results(logs, w).where(tunable())
    found = rows.groupBy("tool", "scope", E.rounded_long("result_bytes").alias("bytes")).agg(E.row_count().alias("occurrences"))
    return first_rows(found.orderBy(F.desc("bytes"), "tool", "scope"), limit)


def _minutes(seconds: Column) -> Column:
    return F.round(seconds / 60.0)


def redundant_reads(logs: DataFrame, w: TimeRange, limit: int | None = TOP) -> DataFrame:
    rows = (tool_results(logs, w).where((F.col("tool_name") == "Read") & F.col("file_path").isNotNull())
            .select(F.coalesce("session_id", F.lit("unknown")).alias("session_id"), "file_path", "timestamp", "id"))
    at = F.unix_micros("timestamp")
    gaps = previous_row(rows, ["session_id", "file_path"], ["timestamp", "id"], at, "before")
    out = (gaps.groupBy("session_id", "file_path").agg(
        E.row_count().alias("reads"), _minutes((F.max(at) - F.min(at)) / 1e6).alias("span_minutes"),
        _minutes(F.coalesce(F.max(at - F.col("before")), F.lit(0)) / 1e6).alias("max_gap_minutes")).where("reads > 1"))
    out = out.withColumn("pattern", read_pattern("reads", "max_gap_minutes"))
    return first_rows(out.orderBy(F.desc("reads"), "session_id", "file_path"), limit)


def read_pattern(reads: str, gap: str) -> Column:
    return (F.when((F.col(reads) >= 3) & (F.col(gap) <= 5), "hunting loop")
            .when(F.col(gap) >= 30, "spread across session").otherwise("tight cluster"))


def _failed_paths(logs: DataFrame, w: TimeRange, tool: str) -> DataFrame:
    rows = tool_results(logs, w).where((F.col("tool_name") == tool) & failed() & F.col("file_path").isNotNull())
    return (rows.groupBy(F.coalesce("session_id", F.lit("unknown")).alias("session_id"), "file_path")
            .agg(E.row_count().alias("failures")))


def edit_failure_loops(logs: DataFrame, w: TimeRange, limit: int | None = TOP) -> DataFrame:
    loops = _failed_paths(logs, w, "Edit").where("failures >= 2")
    return first_rows(loops.orderBy(F.desc("failures"), "session_id", "file_path"), limit)


def slow_and_large(logs: DataFrame, w: TimeRange, min_ms: int = SLOW_MS, min_bytes: int = LARGE_BYTES,
                   limit: int | None = TOP) -> DataFrame:
    rows = sized_results(logs, w).where(tunable() & (F.col("duration_ms") >= min_ms) & (F.col("result_bytes") >= min_bytes))
    return (first_rows(rows.orderBy(F.desc(F.col("duration_ms") * F.col("result_bytes")), "id"), limit)
            .select("id", "tool", "scope", E.rounded_long("duration_ms").alias("duration_ms"),
                    E.rounded_long("result_bytes").alias("bytes")))


def failed_read_paths(logs: DataFrame, w: TimeRange, limit: int | None = None) -> DataFrame:
    return first_rows(_failed_paths(logs, w, "Read").orderBy(F.desc("failures"), "session_id", "file_path"), limit)


def successful_read_paths(logs: DataFrame, w: TimeRange) -> DataFrame:
    rows = tool_results(logs, w).where(
        (F.col("tool_name") == "Read") & (F.col("success") == "true") & F.col("file_path").isNotNull())
    return rows.select(F.coalesce("session_id", F.lit("unknown")).alias("session_id"), "file_path").distinct()


def _piece(path: str, start: Column, length: Column, size: Column, i: int) -> Column:
    """(size, i, text): a piece, with the length of the failed path it belongs to and its number there."""
    return F.struct(size.cast("int").alias("size"), F.lit(i).alias("i"), F.substring(F.col(path), (start + 1).cast("int"), length.cast("int")).alias("text"))


def _piece_bounds(size: Column, i: int) -> tuple[Column, Column]:
    pieces = NEAR_MISS_DISTANCE + 1
    begin, end = F.floor(size * i / pieces), F.floor(size * (i + 1) / pieces)
    return begin, end - begin


def _pieces_of_failed(path: str) -> Column:
    """One piece more than edits allowed, so one of them at least stands unchanged in any near path."""
    size = F.length(path)
    return F.array(*[_piece(path, *_piece_bounds(size, i), size, i) for i in range(NEAR_MISS_DISTANCE + 1)])


def _pieces_of_read(path: str) -> Column:
    """What each piece of a near path would be here, for every length and shift that the edits left over permit."""
    most, out = NEAR_MISS_DISTANCE, []
    for longer in range(-most, most + 1):
        size = F.length(path) - longer
        for i in range(most + 1):
            begin, length = _piece_bounds(size, i)
            # i edits at most lie before piece i, and the rest after it.
            for shift in range(max(-i, longer - (most - i)), min(i, longer + (most - i)) + 1):
                fits = (size > 0) & (begin + shift >= 0) & (begin + shift + length <= F.length(path))
                out.append(F.when(fits, _piece(path, begin + shift, length, size, i)))
    return F.array_compact(F.array(*out))


def path_near_misses(logs: DataFrame, w: TimeRange, limit: int | None = None) -> DataFrame:
    """Every failed path with the nearest path its session did read, at most NEAR_MISS_DISTANCE edits away.

    Only paths that share a piece at a fitting place are compared, so a session's paths do not all meet.
    """
    keys = ["session_id", "size", "i", "text"]
    wrong = failed_read_paths(logs, w).withColumnRenamed("file_path", "failed_path")
    wrong = wrong.select("*", F.inline(_pieces_of_failed("failed_path")))
    good = successful_read_paths(logs, w).select("*", F.inline(_pieces_of_read("file_path")))
    distance = F.levenshtein("failed_path", "file_path", NEAR_MISS_DISTANCE)
    pairs = good.join(wrong, keys).withColumn("edit_distance", distance).where("edit_distance > 0")
    near = (pairs.groupBy("session_id", "failed_path", "failures")
            .agg(F.min(F.struct("edit_distance", "file_path")).alias("m"))
            .select("session_id", "failed_path", F.col("m.file_path").alias("nearest_path"), "m.edit_distance", "failures"))
    return first_rows(near.orderBy(F.desc("failures"), "session_id", "failed_path"), limit)


# Thresholds of the suggestion rules.
CD_PREFIX_MIN = 10
SLOW_BASH_P95_MS = 5_000
OVERSIZED_BYTES = 20_000
TAIL_RATIO, TAIL_MIN_CALLS, TAIL_LIMIT = 3.0, 10, 2
MCP_FAILURE_RATE, MCP_SHARE_RATIO, MCP_LIMIT = 0.10, 2.0, 3
OVERSIZED_LIMIT, HUNTING_LIMIT, LOOP_LIMIT, SLOW_LIMIT = 3, 3, 3, 2


def suggestion_rows(coverage: DataFrame, hotspots: DataFrame, oversized: DataFrame, footprint: DataFrame,
                    servers: DataFrame, reads: DataFrame, loops: DataFrame, slow: DataFrame) -> DataFrame:
    """Every rule's candidates as rows (kind, subject, n, size, extra), each list cut to its rule's limit."""
    def shaped(df: DataFrame, kind: str, subject, n, size, extra) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), n.cast("double").alias("n"),
                         size.cast("double").alias("size"), extra.cast("string").alias("extra"))

    c = F.col
    replacement = F.create_map(*[F.lit(x) for kv in SHELL_REPLACEMENTS.items() for x in kv])[c("command_prefix")]
    slow_bash = hotspots.where(replacement.isNotNull() | (c("p95_ms") >= SLOW_BASH_P95_MS))
    mean = F.floor(c("total_bytes") / c("calls"))
    tail = footprint.where((c("calls") >= TAIL_MIN_CALLS) & (c("p95_bytes") >= OVERSIZED_BYTES)
                           & (c("p95_bytes") >= mean * TAIL_RATIO))
    big = (oversized.where((c("bytes") >= OVERSIZED_BYTES) & (c("scope") != ""))
           .groupBy("scope").agg(F.max_by(F.struct("tool", "bytes", "occurrences"), F.struct("bytes", "tool")).alias("m"))
           .select("scope", "m.*"))
    all_calls, all_bytes = (servers.agg(F.coalesce(F.sum(x), F.lit(0))).scalar() for x in ("calls", "total_bytes"))
    call_share, byte_share = c("calls") / all_calls, F.when(all_bytes > 0, c("total_bytes") / all_bytes).otherwise(0.0)
    costly = servers.where((c("calls") > 0) & ((c("failures") / c("calls") >= MCP_FAILURE_RATE)
                           | ((c("total_bytes") >= OVERSIZED_BYTES) & (byte_share >= call_share * MCP_SHARE_RATIO))))
    parts = [
        shaped(coverage.where(c("cd_prefixed") >= CD_PREFIX_MIN), "cd_prefix", F.lit("cd"), c("cd_prefixed"), c("total"), F.lit(None)),
        shaped(slow_bash.orderBy(F.desc("calls"), "command_prefix").limit(TOP), "bash", c("command_prefix"), c("calls"), c("p95_ms"), replacement),
        shaped(big.orderBy(F.desc("bytes"), "tool", "scope").limit(OVERSIZED_LIMIT), "oversized", c("scope"), c("occurrences"), c("bytes"), c("tool")),
        shaped(tail.orderBy(F.desc("total_bytes"), "tool").limit(TAIL_LIMIT), "tail", c("tool"), c("calls"), c("p95_bytes"), mean),
        shaped(costly.orderBy(F.desc("calls"), "server").limit(MCP_LIMIT), "mcp", c("server"), c("calls"), c("total_bytes"), c("failures")),
        shaped(reads.where("pattern = 'hunting loop'").orderBy(F.desc("reads"), "session_id", "file_path").limit(HUNTING_LIMIT),
               "hunting", c("file_path"), c("reads"), c("span_minutes"), c("session_id")),
        shaped(loops.orderBy(F.desc("failures"), "session_id", "file_path").limit(LOOP_LIMIT),
               "edit_loop", c("file_path"), c("failures"), F.lit(None), c("session_id")),
        shaped(slow.orderBy(F.desc(c("duration_ms") * c("bytes")), "id").limit(SLOW_LIMIT),
               "slow_large", c("scope"), c("duration_ms"), c("bytes"), c("tool")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def suggestions(logs: DataFrame, w: TimeRange, repo: str | None = None) -> DataFrame:
    """The rules applied to whole aggregates; only each rule's own list is cut."""
    return suggestion_rows(
        bash_coverage(logs, w), bash_hotspots(logs, w, None), oversized_results(logs, w, None), tunable_context_footprint(logs, w),
        mcp_server_rollup(mcp_usage(logs, w, repo)), redundant_reads(logs, w, None), edit_failure_loops(logs, w, None),
        slow_and_large(logs, w, limit=None))
