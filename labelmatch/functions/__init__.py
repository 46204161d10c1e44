"""Column expressions and small session helpers."""
