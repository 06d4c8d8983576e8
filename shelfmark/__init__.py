"""Spark-first analytics for large scored media catalogues."""
