"""Keyed collections, inverted indexes and tag search as Spark DataFrames."""
