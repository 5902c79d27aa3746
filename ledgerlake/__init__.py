"""Versioned key/value changelog analytics on Spark DataFrames."""
