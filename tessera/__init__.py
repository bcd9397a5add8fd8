"""Spark-first analytics and retrieval engine for text corpora."""
