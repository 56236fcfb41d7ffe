"""Spark-first text alignment, citation resolution and search for multi-edition corpora."""
