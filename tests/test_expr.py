from conftest import listed
from pyspark.sql import functions as F

from spanloom.functions import expr as E
from spanloom.functions.timebins import bin_index, pick_bucket_seconds
from spanloom.config import TimeRange, utc


def severity(logs, **row):
    return logs(row).first().derived_severity


def test_severity_order(logs):
    assert severity(logs, severity_text="warn", severity_number=17) == "WARN"
    assert severity(logs, severity_text="odd", severity_number=17) == "ERROR"
    assert severity(logs, severity_number=9) == "INFO"
    assert severity(logs, severity_number=4) == "DEBUG"
    assert severity(logs, ev="api_error") == "ERROR"
    # A key that is present with a null value still counts as an error key.
    assert severity(logs, ev="x", a={"error": None}) == "ERROR"
    assert severity(logs, ev="tool_decision", a={"decision": "reject"}) == "ERROR"
    assert severity(logs, ev="tool_decision", a={"decision": "accept"}) == "DEBUG"
    assert severity(logs, ev="compaction") == "WARN"
    assert severity(logs, ev="x", a={"num_non_blocking_error": "2"}) == "WARN"
    assert severity(logs, ev="x", a={"num_non_blocking_error": "0"}) == "INFO"
    assert severity(logs, ev="hook_registered") == "DEBUG"


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{n} {'map<string,string>' if isinstance(values[n], dict) else 'string'}" for n in names))
    return df.select(column.alias("x")).first().x


def test_token_total_takes_one_alias_per_kind(spark):
    attrs = {"gen_ai.usage.input_tokens": "5", "input_tokens": "9", "output_tokens": "2", "cache_read_tokens": "bad", "cache_creation_tokens": "1.5"}
    assert float(one(spark, E.span_token_total("a"), a=attrs)) == 8.5


def test_malformed_json_is_absent(spark):
    attrs = {"tool_name": "mcp_tool", "tool_parameters": "{broken"}
    assert one(spark, E.mcp_aware_tool("a"), a=attrs) == "mcp:unknown"
    assert one(spark, E.safe_json("t").isNull(), t="{broken")


def test_tool_scope_strips_leading_cd(spark):
    attrs = {"tool_name": "Bash", "tool_input": '{"command": " cd a/b && cd c; make all"}'}
    assert one(spark, E.tool_scope("a"), a=attrs) == "make all"


def test_work_category(spark):
    cat = E.work_category("a")
    assert one(spark, cat, a={"query_source": "agent:x", "skill.name": "s"}) == "SUBAGENT"
    assert one(spark, cat, a={"query_source": "sdk", "skill.name": None}) == "SKILL"
    assert one(spark, cat, a={"query_source": "sdk"}) == "MAIN_LOOP"
    assert one(spark, cat, a={"query_source": "compact"}) == "AUXILIARY"
    assert one(spark, cat, a={"z": "1"}) == "AUXILIARY"


def test_attribute_matching(spark):
    a = {"x": "1", "y": None}
    assert one(spark, E.attrs_match("a", ["x=1"]), a=a)
    assert not one(spark, E.attrs_match("a", ["x=1", "y="]), a=a)
    assert one(spark, E.attrs_match_keyed("a", {"y": None, "gone": None, "x": "1"}), a=a)
    assert not one(spark, E.attrs_match_keyed("a", {"y": "v"}), a=a)


def test_full_text_wildcards_and_case(spark):
    assert one(spark, E.full_text("b", "a", "HEL_O"), b="say hello", a={"k": "v"})
    assert one(spark, E.full_text("b", "a", '"k": "V"'), b="-", a={"k": "v"})
    assert not one(spark, E.full_text("b", "a", "zz"), b="say", a={"k": "v"})


def test_notification_tool_use_id(spark):
    x = E.notification_tool_use_id("p")
    assert one(spark, x, p="  <task-notification>\n<tool-use-id> c1 </tool-use-id>") == "c1"
    assert one(spark, x, p="see <task-notification><tool-use-id>c1</tool-use-id>") is None
    assert one(spark, x, p="<task-notification><tool-use-id> </tool-use-id>") is None


def test_small_expressions(spark):
    assert one(spark, E.real_trace_id("t"), t="0" * 32) is None
    assert one(spark, E.error_signature("t"), t="Bash: Command Not Found") == "command-not-found"
    assert one(spark, E.error_signature("t"), t="request Timeout; old_string") == "timeout"
    assert one(spark, E.duration_bucket(F.col("t").cast("double")), t="1000") == "d2"
    assert one(spark, E.trace_service("t"), t="model.x") == "claude_code.models"
    assert one(spark, E.cache_efficiency("a", "b", "c"), a="0", b="0", c="0") is None
    assert one(spark, E.cache_band(E.cache_efficiency("a", "b", "c")), a="1", b="1", c="8") == "mixed"
    assert one(spark, E.cardinality_health(F.col("t").cast("int")), t="5001") == "bad"
    assert one(spark, E.clean_prompt("t", 5), t="a \n b  c d") == "a b c"


def test_bins_start_at_the_range(spark):
    start = utc("2024-03-01T00:07:30")
    df = spark.createDataFrame([("2024-03-01T00:17:29",), ("2024-03-01T00:17:30",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in df.select(bin_index("t", start, 600)).collect()] == [0, 1]
    assert pick_bucket_seconds(TimeRange(start, utc("2024-03-02T00:07:30")), 40) == 3600


def test_unattributed_means_every_repository(logs):
    rows = logs({"ev": "a", "a": {"vcs.repository.url.full": "r"}}, {"ev": "b"}, {"ev": "c", "resource_attributes": {"vcs.repository.url.full": "r"}})
    assert rows.where(E.in_repository("__unattributed__")).count() == 3
    assert listed(rows.where(E.in_repository("r")), "event_name") == [("a",), ("c",)]
