"""Gneiss: repository analytics on Spark DataFrames."""
