"""Column expressions: scores, keys, text, times."""
