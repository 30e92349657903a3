"""spanloom: agent-telemetry analytics on Spark DataFrames."""

from spanloom.config import TelemetryConfig, TimeRange

__all__ = ["TelemetryConfig", "TimeRange"]
