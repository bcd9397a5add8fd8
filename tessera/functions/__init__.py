"""Scalar functions on columns and on query strings."""
