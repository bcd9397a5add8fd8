"""Relational, search and retrieval operators on DataFrames."""
