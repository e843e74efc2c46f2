"""Relationship-aware analytics over typed graphs and text, on Spark DataFrames."""
