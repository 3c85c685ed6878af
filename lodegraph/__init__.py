"""Spark-first retrieval, grounding and evaluation engine over typed graphs and vectors."""
