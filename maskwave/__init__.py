"""Masked-signal analytics and corpus operators on Spark DataFrames."""
