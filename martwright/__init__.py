"""Metric-quality and mart-building library on Spark DataFrames."""
