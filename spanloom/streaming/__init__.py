"""spanloom streaming."""
