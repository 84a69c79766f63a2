"""Temporal concept-graph analytics over ordered text collections, on Spark DataFrames."""
