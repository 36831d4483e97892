"""Hierarchical text retrieval on Spark DataFrames."""
