"""Column expressions and small row helpers."""
