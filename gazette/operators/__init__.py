"""Operators; each takes and returns DataFrames and never reads the wall clock."""
