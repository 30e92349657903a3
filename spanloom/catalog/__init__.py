"""All checkable queries by name."""

from spanloom.catalog.base import ORACLES, QUERIES
from spanloom.catalog import costs, explore, ingest_queries, metric_queries, session_queries, trace_queries  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
