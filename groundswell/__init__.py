"""Displacement-field, station and document analytics on Spark DataFrames."""
