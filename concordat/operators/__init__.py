"""Operators over inventories: DataFrames in, lazy DataFrames out."""
