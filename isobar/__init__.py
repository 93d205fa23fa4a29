"""Batch and incremental analytics over measurement time-series, on Spark DataFrames."""
