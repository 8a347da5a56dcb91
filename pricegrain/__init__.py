"""Catalogue and price analytics on Spark DataFrames."""
