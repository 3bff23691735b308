"""Ranking documents for a profile, and preparing text, on Spark DataFrames."""
