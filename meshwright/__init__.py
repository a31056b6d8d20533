"""Weighted-graph and two-way panel analytics on Spark DataFrames."""
