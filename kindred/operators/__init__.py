"""Operators over canonical tables: each takes DataFrames and returns a DataFrame."""
