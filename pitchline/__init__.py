"""Spark-first match and player analytics: every operator is a DataFrame -> DataFrame function."""
