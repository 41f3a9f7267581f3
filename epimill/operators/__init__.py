"""Relational operators over DataFrames and column names."""
