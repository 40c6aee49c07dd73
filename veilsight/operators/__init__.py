"""Relational operators: DataFrames in, DataFrames out, nothing printed and nothing gathered by the driver."""
