"""Hierarchical snapshot analytics on Spark DataFrames."""
