"""Comparison of captured pages, two at a time, as Spark DataFrame plans."""
