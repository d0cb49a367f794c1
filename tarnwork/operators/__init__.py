"""Relational re-expressions of the engine's operators: DataFrames in, DataFrames out."""
