"""Column expressions and small pure helpers."""
