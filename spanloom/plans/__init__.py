"""spanloom plans."""
