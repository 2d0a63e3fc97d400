"""Comparison, audit and data-preparation analytics on Spark DataFrames."""
