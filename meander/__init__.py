"""Directed-graph analytics on Spark DataFrames."""
