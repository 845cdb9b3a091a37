"""Competitive-intelligence analytics on Spark DataFrames."""
