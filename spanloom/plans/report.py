"""The tuning report: small aggregates worded as Markdown on the driver."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange
from spanloom.operators import tools, tuning

ID_LENGTH = 8
NEAR_MISSES = 25


def report_frames(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> dict[str, DataFrame]:
    """The aggregates behind the sections; each is a top-k list or one row per tool or MCP tool."""
    return {
        "failures": tools.failures_by_signature(logs, w), "near_misses": tuning.path_near_misses(logs, w, NEAR_MISSES),
        "reads": tuning.redundant_reads(logs, w), "loops": tuning.edit_failure_loops(logs, w),
        "hotspots": tuning.bash_hotspots(logs, w), "coverage": tuning.bash_coverage(logs, w),
        "performance": tools.tool_performance(logs, w), "mix": tools.tool_calls(logs, w, repo),
        "footprint": tools.tunable_context_footprint(logs, w), "mcp": tools.mcp_usage(logs, w, repo),
        "oversized": tuning.oversized_results(logs, w), "slow": tuning.slow_and_large(logs, w),
    }


def report_tables(logs: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> dict[str, DataFrame]:
    """The aggregates as small local tables, each computed once.

    All of them read the tool results of the window, so that projection is kept
    while the jobs run side by side.
    """
    results = logs.where((F.col("event_name") == cfg.tool_result) & w.scan()).select(
        "id", "timestamp", "event_date", "event_name", "session_id", "tool_name", "tool", "scope", "file_path", "command", "success", "duration_ms",
        "result_bytes", "repository_url", F.map_filter("attributes", lambda k, v: k.isin("error", "error_type", "tool_parameters")).alias("attributes"))
    results = results.persist()
    try:
        frames = report_frames(results, w, repo, cfg)
        with ThreadPoolExecutor(4) as pool:
            rows = dict(zip(frames, pool.map(lambda df: df.collect(), frames.values())))
    finally:
        results.unpersist()
    out = {name: logs.sparkSession.createDataFrame(rows[name], df.schema) for name, df in frames.items()}
    out["mix"] = tools.with_share(out["mix"])
    out["servers"] = tools.mcp_server_rollup(out.pop("mcp"))
    return out


def _whole(value) -> int:
    return 0 if value is None else int(value)


def _short(text: str | None) -> str:
    text = text or ""
    return text if len(text) <= ID_LENGTH else text[:ID_LENGTH] + "…"


def _share(part, total) -> str:
    return f"{100.0 * part / total:.1f}%" if total else "0.0%"


def word_suggestions(rows: list[Row]) -> list[str]:
    """One sentence per candidate; candidates about the same subject share a bullet."""
    bullets: list[str] = []
    at: dict[str, int] = {}

    def add(key: str, text: str, more: str | None = None) -> None:
        if key in at and more:
            bullets[at[key]] += " " + more
        elif key not in at:
            at[key] = len(bullets)
            bullets.append(text)

    for r in rows:
        n, size = _whole(r.n), _whole(r["size"])
        if r.kind == "cd_prefix":
            add("cd", f"{n} of {size} shell commands begin with `cd`; pass the directory to the command instead.")
        elif r.kind == "bash":
            better = f"use `{r.extra}` instead" if r.extra else "narrow it or run it in the background"
            add("bash:" + r.subject, f"Shell command `{r.subject}` ran {n} times (p95 {size} ms): {better}.")
        elif r.kind == "oversized":
            times = f", {n} times" if n > 1 else ""
            add("scope:" + r.subject, f"`{r.extra}` returned {size} bytes for `{r.subject}`{times}: read it in pages.")
        elif r.kind == "tail":
            add("tail:" + r.subject, f"`{r.subject}` returns {r.extra} bytes on average but {size} at p95 over {n} calls: cap the largest results.")
        elif r.kind == "mcp":
            add("mcp:" + r.subject, f"MCP server `{r.subject}`: {n} calls, {r.extra} failed, {size} bytes of results: check that it is worth keeping.")
        elif r.kind == "hunting":
            add("file:" + r.subject, f"`{r.subject}` was read {n} times within {size} min in session `{_short(r.extra)}`: read it once.")
        elif r.kind == "edit_loop":
            add("file:" + r.subject, f"Edits of `{r.subject}` failed {n} times in session `{_short(r.extra)}`: match a longer text.",
                f"Edits of it also failed {n} times: match a longer text.")
        elif r.kind == "slow_large":
            first = (r.subject or "").split(" ")[0]
            fact = f"One call took {n} ms and returned {size} bytes (`{r.subject}`)."
            add("bash:" + first if "bash:" + first in at else f"slow:{r.subject}:{n}", f"`{r.extra}`: {fact}", fact)
    return bullets


def _table(title: str, heads: list[str], rows: list[list]) -> list[str]:
    if not rows:
        return []
    lines = [f"## {title}", "", "| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)]
    return lines + ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows] + [""]


def report_markdown(logs: DataFrame, w: TimeRange, repo: str | None = None) -> str:
    frames = report_tables(logs, w, repo)
    order = F.when(F.col("kind") == "cd_prefix", 0)
    for i, kind in enumerate(("bash", "oversized", "tail", "mcp", "hunting", "edit_loop", "slow_large"), 1):
        order = order.when(F.col("kind") == kind, i)
    rows = tuning.suggestions(logs, w, repo)
    suggestions = word_suggestions(rows.orderBy(order, F.desc("n"), "subject").collect())
    got = {name: df.collect() for name, df in frames.items()}
    minutes = max(1, int(w.seconds // 60))
    out = ["# Tool use report", "", f"Window: {minutes} minute(s) from {w.start.isoformat()}.", ""]
    if not got["mix"]:
        return "\n".join(out + ["No tool results in this window."])
    out += _table("Failures", ["Tool", "Error type", "Cause", "Example scope", "Example message", "Count"], [
        [r.tool, r.error_type, r.error_signature, r.example_scope, r.example_message, r.failures] for r in got["failures"]])
    out += _table("Path near-misses", ["Session", "Failed path", "Nearest path read", "Distance", "Failures"], [
        [_short(r.session_id), r.failed_path, r.nearest_path, r.edit_distance, r.failures] for r in got["near_misses"]])
    out += _table("Redundant reads", ["Session", "File", "Reads", "Span (min)", "Longest gap (min)", "Pattern"], [
        [_short(r.session_id), r.file_path, r.reads, _whole(r.span_minutes), _whole(r.max_gap_minutes), r.pattern] for r in got["reads"]])
    out += _table("Edit failure loops", ["Session", "File", "Failures"], [[_short(r.session_id), r.file_path, r.failures] for r in got["loops"]])
    if suggestions:
        out += ["## Suggestions", "", *[f"- {s}" for s in suggestions], ""]
    cover = got["coverage"][0]
    out += _table("Shell command hotspots", ["Command", "Calls", "Avg ms", "p95 ms", "Avg bytes"], [
        [r.command_prefix, r.calls, _whole(r.avg_ms), _whole(r.p95_ms), _whole(r.avg_out)] for r in got["hotspots"]])
    out += [f"{cover.with_command} of {cover.total} shell calls carry their command; {cover.cd_prefixed} begin with `cd`.", ""]
    out += _table("Tool performance", ["Tool", "Calls", "Avg ms", "p95 ms", "Avg bytes"], [
        [r.tool, r.calls, _whole(r.avg_ms), _whole(r.p95_ms), _whole(r.avg_out)] for r in got["performance"]])
    out += _table("Tool call mix", ["Tool", "Calls", "Share"], [[r.tool, r.calls, f"{r.share_percent:.1f}%"] for r in got["mix"]])
    bytes_all = sum(r.total_bytes for r in got["footprint"])
    out += _table("Context footprint", ["Tool", "Calls", "Bytes", "Share", "Avg bytes", "p95 bytes"], [
        [r.tool, r.calls, r.total_bytes, _share(r.total_bytes, bytes_all), r.total_bytes // r.calls, r.p95_bytes] for r in got["footprint"]])
    server_bytes = sum(_whole(r.total_bytes) for r in got["servers"])
    out += _table("MCP servers", ["Server", "Calls", "Failure rate", "p95 ms", "Bytes", "Share"], [
        [r.server, r.calls, _share(r.failures, r.calls), _whole(r.p95_ms), _whole(r.total_bytes), _share(_whole(r.total_bytes), server_bytes)]
        for r in got["servers"]])
    out += _table("Oversized results", ["Tool", "Scope", "Bytes", "Calls"], [[r.tool, r.scope, r.bytes, r.occurrences] for r in got["oversized"]])
    return "\n".join(out)
