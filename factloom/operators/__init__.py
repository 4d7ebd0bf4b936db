"""Operators of the evidence graph, as functions from DataFrames to DataFrames."""
