"""Ranking and preference analytics on Spark DataFrames."""
