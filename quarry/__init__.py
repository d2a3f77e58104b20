"""Columnar event-data analytics on Spark DataFrames."""
