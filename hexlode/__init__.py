"""Hexlode: hybrid retrieval and corpus processing on Spark DataFrames."""
