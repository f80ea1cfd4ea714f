"""Attribute-filtered vector search and metadata analytics on Spark DataFrames."""
