"""Relational steps. Every operator is a function of DataFrames to a DataFrame."""
