"""Investigate transaction ledgers with PySpark DataFrames."""
