"""Spark-native record curation, search and evaluation engine."""
