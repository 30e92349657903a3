"""spanloom operators."""
