"""Kerbside: spatio-temporal event analytics on Spark DataFrames."""
