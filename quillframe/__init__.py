"""Stylometry and corpus analytics on Spark DataFrames."""
