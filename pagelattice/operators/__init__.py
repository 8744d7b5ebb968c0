"""Comparison operators over DataFrames."""
