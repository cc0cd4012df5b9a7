"""Sponsor-segment analytics on Spark DataFrames."""
