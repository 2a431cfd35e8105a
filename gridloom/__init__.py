"""Gridloom: detection-data analytics on Spark DataFrames."""
