"""Interval and tabular analytics on Spark DataFrames."""
