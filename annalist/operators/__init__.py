"""Operators on events, facts and controls: DataFrames in, DataFrames out."""
