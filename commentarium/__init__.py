"""Audience-comment analytics on Spark: tables in, DataFrames out, nothing collected on the way."""
