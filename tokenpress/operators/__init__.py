"""Operators on DataFrames of texts, lines, turns and records."""
