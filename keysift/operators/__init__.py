"""Operators: each takes and returns DataFrames or Columns, lazily."""
