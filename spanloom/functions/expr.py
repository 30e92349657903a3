"""Column expressions shared by the operators. No Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig

MONEY = "decimal(38,12)"

# Events and keys that decide a severity when the record carries none.
ERROR_EVENTS = ("api_error", "internal_error", "api_retries_exhausted")
ERROR_KEYS = ("error", "error_type", "error_name", "error_code")
DEBUG_EVENTS = (
    "hook_execution_start", "hook_execution_complete", "hook_registered",
    "api_request_body", "api_response_body",
)

# Attribute aliases of the four token kinds, in order of preference.
TOKEN_ALIASES = {
    "input": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens",
              "anthropic.usage.input_tokens", "input_tokens"),
    "output": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens",
               "anthropic.usage.output_tokens", "output_tokens"),
    "cache_creation": ("gen_ai.usage.cache_creation_input_tokens", "gen_ai.usage.cache_creation_tokens",
                       "anthropic.usage.cache_creation_input_tokens", "anthropic.usage.cache_creation_tokens",
                       "cache_creation_input_tokens", "cache_creation_tokens"),
    "cache_read": ("gen_ai.usage.cache_read_input_tokens", "gen_ai.usage.cache_read_tokens",
                   "anthropic.usage.cache_read_input_tokens", "anthropic.usage.cache_read_tokens",
                   "cache_read_input_tokens", "cache_read_tokens"),
}

# Patterns over error messages, first match wins.
ERROR_PATTERNS = (
    ("command-not-found", r"command not found"),
    ("missing-path", r"no such file or directory|does not exist|cannot find"),
    ("permission-denied", r"permission denied|operation not permitted|not allowed"),
    ("timeout", r"timed out|timeout"),
    ("old-string-mismatch", r"string to replace not found|old_string"),
)

CD_CHAIN = r"^\s*(cd\s+[^&;|\n]*(&&|;|\n)\s*)+"
IMAGE_PATH = r"(?i)\.(png|jpe?g|gif|webp|bmp|ico|svg|pdf)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(text: Column | str, kind: str = "double") -> Column:
    """Text to number; unparsable text is NULL."""
    return _col(text).try_cast(kind)


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(_col(text), F.lit(""))


def rounded_long(value: Column | str) -> Column:
    """Round, then cast: a bare cast would truncate."""
    return F.round(_col(value)).cast("long")


def derive_severity(attrs: Column | str, text: Column | str, level: Column | str) -> Column:
    attrs, level = _col(attrs), _col(level)
    label = F.upper(_col(text))
    event, decision = attrs["event.name"], attrs["decision"]
    has_error_key = F.lit(False)
    for key in ERROR_KEYS:
        has_error_key = has_error_key | F.map_contains_key(attrs, F.lit(key))

    def sure(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    return (
        F.when(label.isin("ERROR", "WARN", "INFO", "DEBUG"), label)
        .when(level >= 17, "ERROR").when(level >= 13, "WARN").when(level >= 9, "INFO").when(level > 0, "DEBUG")
        .when(sure(event.isin(*ERROR_EVENTS)) | sure(has_error_key)
              | sure(attrs["success"] == "false") | sure(decision == "reject"), "ERROR")
        .when(sure(event == "compaction") | sure(attrs["status"] == "disconnected")
              | sure(attrs["num_non_blocking_error"] != "0"), "WARN")
        .when(sure(event.isin(*DEBUG_EVENTS)) | sure((event == "tool_decision") & (decision == "accept")), "DEBUG")
        .otherwise("INFO")
    )


def token_part(attrs: Column | str, kind: str) -> Column:
    attrs = _col(attrs)
    return F.coalesce(*[number(attrs[key], MONEY) for key in TOKEN_ALIASES[kind]], F.lit(0).cast(MONEY))


def span_token_total(attrs: Column | str) -> Column:
    total = token_part(attrs, "input")
    for kind in ("output", "cache_creation", "cache_read"):
        total = total + token_part(attrs, kind)
    return total.cast(MONEY)


def safe_json(text: Column | str) -> Column:
    """The parsed document, or NULL for absent or malformed text."""
    return F.try_parse_json(blank_to_null(text))


def json_text(document: Column | str, key: str) -> Column:
    return F.get_json_object(_col(document), f"$.{key}")


def mcp_aware_tool(attrs: Column | str, cfg: TelemetryConfig = CFG) -> Column:
    attrs = _col(attrs)
    server = F.coalesce(blank_to_null(json_text(attrs["tool_parameters"], "mcp_server_name")), F.lit("unknown"))
    return (F.when(attrs["tool_name"] == cfg.mcp_tool, F.concat(F.lit("mcp:"), server))
            .otherwise(F.coalesce(attrs["tool_name"], F.lit("unknown"))))


def strip_cd(command: Column | str) -> Column:
    return F.ltrim(F.regexp_replace(_col(command), CD_CHAIN, ""))


def tool_scope(attrs: Column | str, cfg: TelemetryConfig = CFG) -> Column:
    attrs = _col(attrs)
    return (F.when(attrs["tool_name"] == cfg.mcp_tool,
                   F.coalesce(json_text(attrs["tool_parameters"], "mcp_tool_name"), F.lit("")))
            .otherwise(F.coalesce(json_text(attrs["tool_input"], "file_path"),
                                  strip_cd(json_text(attrs["tool_input"], "command")), F.lit(""))))


def work_category(attrs: Column | str, cfg: TelemetryConfig = CFG) -> Column:
    attrs = _col(attrs)
    return work_category_of(attrs["query_source"], F.map_contains_key(attrs, F.lit("skill.name")), cfg)


def work_category_of(query_source: Column | str, has_skill: Column | str, cfg: TelemetryConfig = CFG) -> Column:
    query_source = _col(query_source)
    return (F.when(query_source.startswith(cfg.subagent_source_prefix), "SUBAGENT")
            .when(_col(has_skill), "SKILL")
            .when(query_source.isin(*cfg.main_loop_sources), "MAIN_LOOP")
            .otherwise("AUXILIARY"))


def trace_service(root: Column | str) -> Column:
    root = _col(root)

    def any_prefix(*prefixes: str) -> Column:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | root.startswith(prefix)
        return test

    return (F.when(any_prefix("claude_code.interaction", "session.", "context."), "claude_code.session")
            .when(any_prefix("claude_code.tool", "tool."), "claude_code.tools")
            .when(any_prefix("claude_code.llm", "claude_code.model", "model."), "claude_code.models")
            .otherwise("claude_code"))


def duration_bucket(ms: Column | str) -> Column:
    ms = _col(ms)
    return F.when(ms < 100, "d0").when(ms < 1000, "d1").when(ms < 5000, "d2").otherwise("d3")


def attrs_match(attrs: Column | str, pairs: Iterable[str]) -> Column:
    """True when the row carries every ``key=value`` pair."""
    entries = F.map_entries(_col(attrs))
    test = F.lit(True)
    for pair in pairs:
        test = test & F.coalesce(
            F.exists(entries, lambda e: F.coalesce(F.concat(e["key"], F.lit("="), e["value"]) == pair, F.lit(False))),
            F.lit(False))
    return test


def attrs_match_keyed(attrs: Column | str, wanted: Mapping[str, str | None]) -> Column:
    """Null-safe equality per key; an absent key equals a wanted NULL."""
    attrs = _col(attrs)
    test = F.lit(True)
    for key, value in wanted.items():
        test = test & attrs[key].eqNullSafe(F.lit(value))
    return test


def canonical_attributes(attrs: Column | str) -> Column:
    """A stable text of an attribute map: entries by key length, then key."""
    attrs = _col(attrs)
    ordered = F.array_sort(F.transform(
        F.map_entries(attrs), lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    texts = F.transform(ordered, lambda e: F.concat(
        F.lit('"'), e["k"], F.lit('": '),
        F.coalesce(F.concat(F.lit('"'), F.replace(e["v"], F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}"))


def full_text(body: Column | str, attrs: Column | str, query: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the query stay wildcards."""
    if not query:
        return F.lit(True)
    pattern = f"%{query}%"
    return (F.coalesce(_col(body).ilike(pattern), F.lit(False))
            | F.coalesce(canonical_attributes(attrs).ilike(pattern), F.lit(False)))


def clean_prompt(text: Column | str, length: int | None = None) -> Column:
    """Runs of white space as one blank; the whole text, or its first ``length`` characters."""
    clean = F.regexp_replace(_col(text), r"\s+", " ")
    return clean if length is None else F.substring(clean, 1, length)


def real_trace_id(trace_id: Column | str) -> Column:
    return F.nullif(F.nullif(_col(trace_id), F.lit("")), F.lit("0" * 32))


def notification_tool_use_id(prompt: Column | str) -> Column:
    """Tool call id inside a machine-written task notification, else NULL."""
    trimmed = F.regexp_replace(_col(prompt), r"^\s+", "")
    inner = blank_to_null(F.trim(F.regexp_extract(trimmed, r"(?s)<tool-use-id>(.*?)</tool-use-id>", 1)))
    return F.when(trimmed.startswith("<task-notification>"), inner)


def cache_efficiency(input_tokens: Column | str, creation: Column | str, read: Column | str,
                     empty: float | None = None) -> Column:
    input_tokens, creation, read = (_col(c).cast("double") for c in (input_tokens, creation, read))
    side = input_tokens + creation + read
    return F.when(side > 0, read / side).otherwise(F.lit(empty).cast("double"))


def cache_band(ratio: Column | str) -> Column:
    ratio = _col(ratio)
    return F.when(ratio >= 0.85, "strong").when(ratio >= 0.6, "mixed").when(ratio.isNotNull(), "weak")


def cardinality_health(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n < 1000, "ok").when(n <= 5000, "warn").otherwise("bad")


def error_signature(message: Column | str) -> Column:
    message = _col(message)
    chain = None
    for label, pattern in ERROR_PATTERNS:
        test = message.rlike(f"(?i){pattern}")
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise("other")


def moving(delta: Column | str = "value_delta") -> Column:
    """Increment is not zero; an unknown (NULL) increment counts as moving."""
    return ~_col(delta).eqNullSafe(F.lit(0.0))


def in_repository(repository: str | None, column: str = "repository_url", cfg: TelemetryConfig = CFG) -> Column:
    """Repository scope; none, or the "unattributed" marker, means every row."""
    if repository is None or repository == cfg.unattributed:
        return F.lit(True)
    return F.col(column) == repository


def row_count() -> Column:
    return F.count(F.lit(1))
