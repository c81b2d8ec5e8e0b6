"""Batch network routing and geospatial graph analytics on Spark DataFrames."""
