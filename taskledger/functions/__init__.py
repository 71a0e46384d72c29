"""Column expressions and JSON."""
