"""Registered queries: DataFrame plans over the test tables, with their SQL."""
