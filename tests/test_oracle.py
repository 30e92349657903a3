"""Queries against their SQL twins on the smallest tables.

A part of every module runs by default; ``SPANLOOM_ALL=1`` runs them all.
``check.py`` does the same from the command line.
"""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows

SF = "/root/testdata/sf0.001"
SOME = ["log_histogram", "attribute_pairs", "tool_performance", "tool_repeats", "mcp_server_rollup", "subagent_usage", "path_near_misses", "cost_by_category",
        "session_summaries_cacheefficiency_asc", "prompt_timeline", "nest_turns", "metric_series", "metric_trend_p95", "select_exemplars", "sparklines_combined",
        "trends", "usage_calendar", "purge_kept_points", "ingest_health", "trace_list_err_before", "trace_facets", "span_tree", "trace_cost_breakdown",
        "focused_resolution", "flatten_otlp_logs", "repair_deltas", "stream_counter_deltas"]
NAMES = sorted(queries()) if os.environ.get("SPANLOOM_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in oracle_sql():
        cur = con.execute(oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
