"""Operators for preparing training text, apart from the telemetry library."""
