"""Spark-first analytics over GPS tracks and training-data corpora."""
