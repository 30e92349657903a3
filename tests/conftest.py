import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanloom import schema  # noqa: E402
from spanloom.config import TimeRange  # noqa: E402
from spanloom.sources.deltas import counter_deltas  # noqa: E402

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
HOUR = TimeRange(T0, T0 + timedelta(hours=1))


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("spanloom-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


def _rows(spark, shape, rows, **defaults):
    filled = [{**{f.name: None for f in shape.fields}, "resource_attributes": {}, "scope_attributes": {}, **defaults, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in shape.fields) for r in filled], shape)


@pytest.fixture(scope="session")
def logs(spark):
    """Logs from dicts: ``t`` seconds after T0, ``ev``, columns, and attributes under ``a``."""
    def make(*rows):
        shaped = []
        for i, r in enumerate(rows):
            r = dict(r)
            attrs = {**({"event.name": r.pop("ev")} if "ev" in r else {}), **r.pop("a", {})}
            shaped.append({"id": i, "timestamp": at(r.pop("t", i)), "attributes": attrs, "nested_attribute_keys": [], **r})
        return schema.enrich_logs(_rows(spark, schema.LOG_SCHEMA, shaped))
    return make


@pytest.fixture(scope="session")
def raw_points(spark):
    def make(*rows):
        shaped = []
        for i, r in enumerate(rows):
            r = dict(r)
            value = r.pop("v")
            shaped.append({"id": i, "timestamp": at(r.pop("t", i)), "metric_name": r.pop("m", "claude_code.cost.usage"), "unit": "u",
                           "value_double": float(value) if not isinstance(value, bool) else None, "value_kind": "double",
                           "attributes": r.pop("a", {"session.id": "s"}), **r})
        return schema.enrich_points(_rows(spark, schema.POINT_SCHEMA, shaped))
    return make


@pytest.fixture(scope="session")
def points(raw_points):
    return lambda *rows: counter_deltas(raw_points(*rows))


@pytest.fixture(scope="session")
def spans(spark):
    """Spans from dicts: ``s`` span id, ``p`` parent, ``t`` start, ``d`` seconds, ``n`` name."""
    def make(*rows):
        shaped = []
        for i, r in enumerate(rows):
            r = dict(r)
            start, length = r.pop("t", i), r.pop("d", 1)
            shaped.append({"id": i, "trace_id": r.pop("tr", "t"), "span_id": r.pop("s", f"s{i}"), "parent_span_id": r.pop("p", None),
                           "name": r.pop("n", "claude_code.tool"), "start_timestamp": at(start), "end_timestamp": at(start + length),
                           "duration_nanos": int(length * 1e9), "status_code": r.pop("st", "ok"), "scope_name": "com.anthropic.claude_code.tracing",
                           "attributes": r.pop("a", {}), **r})
        return schema.enrich_spans(_rows(spark, schema.SPAN_SCHEMA, shaped))
    return make


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
