"""Column expressions and vector functions."""
