"""Reusable building blocks: each one is a function from DataFrames to a DataFrame."""
