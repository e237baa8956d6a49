"""Curatrix: catalogue curation analytics on Spark DataFrames."""
