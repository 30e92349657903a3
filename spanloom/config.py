"""Names the operators read, and the time ranges they are asked about."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TelemetryConfig:
    # Event, metric, span and attribute names emitted by the agents.
    tool_result: str = "tool_result"
    tool_decision: str = "tool_decision"
    api_request: str = "api_request"
    api_request_body: str = "api_request_body"
    api_error: str = "api_error"
    user_prompt: str = "user_prompt"
    assistant_response: str = "assistant_response"
    hook_complete: str = "hook_execution_complete"
    skill_activated: str = "skill_activated"
    compaction: str = "compaction"
    cost_metric: str = "claude_code.cost.usage"
    token_metric: str = "claude_code.token.usage"
    active_metric: str = "claude_code.active_time.total"
    session_metric: str = "claude_code.session.count"
    commit_metric: str = "claude_code.commit.count"
    pull_request_metric: str = "claude_code.pull_request.count"
    lines_metric: str = "claude_code.lines_of_code.count"
    edit_decision_metric: str = "claude_code.code_edit_tool.decision"
    span_scope: str = "com.anthropic.claude_code.tracing"
    interaction_span: str = "claude_code.interaction"
    tool_span: str = "claude_code.tool"
    tool_execution_span: str = "claude_code.tool.execution"
    blocked_span: str = "claude_code.tool.blocked_on_user"
    llm_span: str = "claude_code.llm_request"
    mcp_tool: str = "mcp_tool"
    mcp_prefix: str = "mcp__"
    subagent_tool: str = "Agent"
    default_subagent: str = "general-purpose"
    main_loop_sources: tuple[str, ...] = ("sdk", "repl_main_thread")
    subagent_source_prefix: str = "agent:"
    externally_determined_tools: tuple[str, ...] = ("Agent", "Task", "WebSearch", "WebFetch")
    repository_key: str = "vcs.repository.url.full"
    unattributed: str = "__unattributed__"
    token_types: tuple[str, ...] = ("input", "output", "cacheCreation", "cacheRead")
    min_cache_input_tokens: int = 100_000


CFG = TelemetryConfig()


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def micros(when: datetime) -> int:
    if when.tzinfo is None:
        when = when.replace(tzinfo=timezone.utc)
    return (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _utc_day(when: datetime) -> date:
    return (when.astimezone(timezone.utc) if when.tzinfo else when).date()


def ts_lit(when: datetime) -> Column:
    """A foldable timestamp literal that does not depend on the session time zone."""
    return F.timestamp_micros(F.lit(micros(when)))


@dataclass(frozen=True)
class TimeRange:
    """A closed range ``[start, end]``; either bound may be open (None)."""

    start: datetime | None = None
    end: datetime | None = None

    @property
    def seconds(self) -> float:
        return (self.end - self.start).total_seconds()

    @property
    def prior_start(self) -> datetime:
        return self.start - (self.end - self.start)

    def contains(self, column: str = "timestamp", half_open: bool = False) -> Column:
        test = F.lit(True)
        if self.start is not None:
            test = test & (F.col(column) >= ts_lit(self.start))
        if self.end is not None:
            upper = ts_lit(self.end)
            test = test & ((F.col(column) < upper) if half_open else (F.col(column) <= upper))
        return test

    def scan(self, column: str = "timestamp", half_open: bool = False) -> Column:
        """``contains``, with the implied bounds on the day partition so that scans skip other days."""
        test = self.contains(column, half_open)
        if self.start is not None:
            test = test & (F.col("event_date") >= F.lit(_utc_day(self.start)))
        if self.end is not None:
            test = test & (F.col("event_date") <= F.lit(_utc_day(self.end)))
        return test

    def prior(self, column: str = "timestamp") -> Column:
        """The half-open range of equal length that ends where this one starts."""
        return (F.col(column) >= ts_lit(self.prior_start)) & (F.col(column) < ts_lit(self.start))

    def with_prior(self) -> "TimeRange":
        return TimeRange(self.prior_start, self.end)
