"""Spark-first analytics for comparing and cross-checking structured documents."""
